"""The shipped rule sets, one per kind of artifact, over feature columns of the names used here.

Features that need software absent from this engine (molecule descriptors, conformer geometry) are input tables;
their rules are here all the same.  Weight 0 discloses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions import sequences as S
from gatehouse.operators.rules import CALIBRATED, RuleSet, exceedance

# Limits of the synthesis rules.
GC, MAX_RUN, MAX_G, LENGTHS, STEM = (0.25, 0.65), 8, 3, (18, 3000), 12
CROSS, CROSS_SEVERE = 12, 20


def c(name: str) -> Column:
    return F.col(name)


def outside(value: Column, low: float, high: float) -> Column:
    return ~value.between(low, high)


def dna_features(df: DataFrame, seq: str, scans: bool = True) -> DataFrame:
    """``length, gc, max_run, max_g_run``, and with ``scans`` also ``hairpin`` and ``sites``."""
    s = F.upper(F.col(seq))
    df = df.withColumn("length", F.length(s)).withColumn("gc", S.gc_fraction(s))
    df = df.withColumn("max_run", S.longest_run(s)).withColumn("max_g_run", S.longest_run(s, "G"))
    return df.withColumn("hairpin", S.hairpin(s)).withColumn("sites", S.restriction_sites(s)) if scans else df


def dna_rules(scans: bool = True) -> RuleSet:
    rules = (
        RuleSet("gen-dna-validity")
        .rule("GC_OUT_OF_BAND", outside(c("gc"), *GC), F.format_string("GC %.2f outside the band", c("gc")), 1.5)
        .rule("HOMOPOLYMER_RUN", c("max_run") > MAX_RUN, F.format_string("run of %d", c("max_run")), 1.5)
        .rule("LENGTH_OUT_OF_RANGE", outside(c("length"), *LENGTHS), F.format_string("length %d", c("length")), 1.0)
    )
    if scans:
        rules = rules.rule("STRONG_HAIRPIN", c("hairpin.stem") >= STEM, F.format_string("stem of %d", c("hairpin.stem")), 1.0)
    rules = rules.rule("POLY_G_RUN", c("max_g_run") > MAX_G, F.format_string("G run of %d", c("max_g_run")), 0.0)
    return rules.rule("RESTRICTION_SITE", F.size("sites") > 0, F.format_string("%d sites", F.size("sites")), 0.0) if scans else rules


def dna_severity(scans: bool = True) -> Column:
    """How far all condemning limits are exceeded, summed."""
    gc, n = c("gc"), c("length")
    total = exceedance(gc, GC[1]) + exceedance(F.lit(GC[0]), F.greatest(gc, F.lit(1e-6))) + exceedance(c("max_run"), float(MAX_RUN))
    total = total + exceedance(n, float(LENGTHS[1])) + exceedance(F.lit(float(LENGTHS[0])), F.greatest(n, F.lit(1)))
    return total + exceedance(c("hairpin.stem"), float(STEM)) if scans else total


def _over(value: Column, limit: float) -> Column:
    return exceedance(value, F.lit(limit))


def _under(value: Column, limit: float) -> Column:
    return exceedance(F.lit(limit), F.greatest(value, F.lit(1e-6)))


def molecule_severity() -> Column:
    """10 for an invalid molecule, else how far the condemning limits are exceeded."""
    return F.when(~c("valid"), 10.0).otherwise(_over(c("sa"), 6.0) + _over(c("mw"), 900.0) + _over(c("logp"), 7.0))


def pose_severity() -> Column:
    """Bonds, angles and strain count where the reference geometry is known (``ref_ok``, and ``energy_ok`` for strain)."""
    bonds = _under(c("bond_lo"), 0.75) + _over(c("bond_hi"), 1.25) + _over(c("angle_hi") - 1.0, 0.25)
    strain = _over(F.log10(F.greatest(c("energy_ratio"), F.lit(1.0))), 2.0)
    shape = _over(c("ring_dev"), 0.25) + _over(c("twist"), 25.0) + _under(c("clash_rel"), 0.60)
    return F.when(c("ref_ok"), bonds).otherwise(0.0) + shape + F.when(c("ref_ok") & c("energy_ok"), strain).otherwise(0.0)


def cofold_severity() -> Column:
    """0 without a frame; otherwise depth of the clash, overlap and distance."""
    near = F.coalesce(_under(c("min_rel"), 0.75), F.lit(0.0))
    return F.when(c("framed"), near + _over(F.coalesce("overlap_frac", F.lit(0.0)), 0.075) + _over(c("min_dist"), 5.0)).otherwise(0.0)


def complex_severity() -> Column:
    """0 without a frame; otherwise depth of the overlap, burial and distance."""
    return F.when(c("framed"), _over(c("max_overlap"), 0.90) + _over(c("buried_frac"), 0.10) + _over(c("min_dist"), 5.0)).otherwise(0.0)


def dna_batch_rules() -> RuleSet:
    """Over one row ``mild`` (pairs with a common stretch from 12) and ``severe`` (from 20)."""
    return (
        RuleSet("gen-dna-batch-validity")
        .rule("CROSS_HYBRIDIZATION", (c("mild") > 0) & (c("severe") == 0), weight=0.0)
        .rule("SEVERE_CROSS_HYBRIDIZATION", c("severe") > 0, weight=1.5)
    )


# Forbidden motifs of promoters, and the share below which one counts as rare.
FORBIDDEN = ["GGTCTC", "GAGACC", "CGTCTC", "GAGACG", "GAATTC", "GGATCC", "TTTTTTT"]
RARE = 0.02


def calibrate_promoters(reference: DataFrame, seq: str) -> DataFrame:
    """One row: ``ref_max_run`` and ``rare`` motifs of the pool of known-good sequences; the defaults for an empty pool."""
    share = [F.avg(F.contains(F.col(seq), F.lit(m)).cast("int")) for m in FORBIDDEN]
    rare = F.filter(F.array(*[F.when(F.coalesce(s, F.lit(0.0)) < RARE, F.lit(m)) for s, m in zip(share, FORBIDDEN, strict=True)]), lambda m: m.isNotNull())
    return reference.agg(F.coalesce(F.max(S.longest_run(F.col(seq))), F.lit(MAX_RUN)).alias("ref_max_run"), rare.alias("rare"))


def promoter_rules(seq: str = "seq") -> RuleSet:
    """Over ``box`` (promoter_boxes), ``gc``, ``max_run`` and the calibration's ``ref_max_run`` and ``rare``."""
    near = (c("box.h35") <= 2) & (c("box.h10") <= 2)
    motif = F.exists("rare", lambda m: F.contains(F.col(seq), m))
    return (
        RuleSet("σ70-promoter-design")
        .rule("C1 −35 box", c("box.h35").isNull() | (c("box.h35") > 2))
        .rule("C2 −10 box", c("box.h10").isNull() | (c("box.h10") > 2))
        .rule("C3 spacer", near & outside(c("box.spacer"), 15, 19))
        .rule("C4 GC band", outside(c("gc"), 0.30, 0.70))
        .rule("C5 homopolymer", c("max_run") > c("ref_max_run"), kind=CALIBRATED)
        .rule("C6 forbidden motif", motif, kind=CALIBRATED)
    )


def readout_rules() -> RuleSet:
    """Over ``built, value, replicate_cv, signal, controls_ok``."""
    return (
        RuleSet("σ70-promoter-readout")
        .rule("QA built/measured", ~c("built") | c("value").isNull(), kind=CALIBRATED)
        .rule("QB replicate CV", c("built") & (c("replicate_cv") > 0.30), kind=CALIBRATED)
        .rule("QC dynamic range", (c("built") & (c("signal") < 0.05)) | (c("signal") > 10), kind=CALIBRATED)
        .rule("QD controls", ~c("controls_ok"), kind=CALIBRATED)
    )


def antibody_rules() -> RuleSet:
    """Over the columns of ``antibody.features``."""
    some = lambda name: F.size(name) > 0
    return (
        RuleSet("antibody-developability")
        .rule("UNPAIRED_CYSTEINE", some("odd_cys_chains"), weight=1.5)
        .rule("N_GLYCOSYLATION_SEQUON_CDR", some("cdr_sequons"), weight=1.5)
        .rule("CDR_LENGTH_OUT_OF_RANGE", c("h3_len").isNotNull() & outside(c("h3_len"), 3, 32))
        .rule("EXTREME_FV_CHARGE", outside(c("pi"), 5.0, 9.5))
        .rule("DEAMIDATION_HOTSPOT_CDR", some("cdr_deamidation"), weight=0.0)
        .rule("ISOMERIZATION_HOTSPOT_CDR", some("cdr_isomerization"), weight=0.0)
        .rule("FRAMEWORK_GLYCOSYLATION", some("framework_sequons"), weight=0.0)
        .rule("OXIDATION_PRONE_CDR", some("cdr_oxidation"), weight=0.0)
        .rule("FRAGMENTATION_DP", some("fragmentation"), weight=0.0)
        .rule("N_TERMINAL_PYROGLUTAMATE", some("nterm_pyroglu"), weight=0.0)
        .rule("CHARGE_ASYMMETRY", c("has_light") & (F.abs(c("charge_h") - c("charge_l")) > 6.0), weight=0.0)
        .rule("HYDROPHOBICITY_HIGH", c("cdr_gravy") > 0.30, weight=0.0)
        .rule("CDR_DETECTION_UNCERTAIN", ~c("cdr_ok"), weight=0.0)
    )


def molecule_rules() -> RuleSet:
    """Over ``valid, sa, mw, logp, hbd, hba, rotb, tpsa, n_alerts``; nothing else is read from an invalid molecule."""
    v = c("valid")
    broken = (c("mw") > 500).cast("int") + (c("logp") > 5).cast("int") + (c("hbd") > 5).cast("int") + (c("hba") > 10).cast("int")
    return (
        RuleSet("mol-validity")
        .rule("INVALID_MOLECULE", ~v, weight=2.0)
        .rule("UNSYNTHESIZABLE", v & (c("sa") > 6), weight=1.5)
        .rule("EXTREME_PROPERTY", v & ((c("mw") > 900) | (c("logp") > 7)), weight=1.5)
        .rule("STRUCTURAL_ALERT", v & (c("n_alerts") > 0), weight=0.0)
        .rule("LIPINSKI_RO5", v & (broken >= 2), weight=0.0)
        .rule("VEBER", v & ((c("rotb") > 10) | (c("tpsa") > 140)), weight=0.0)
    )


def pose_rules() -> RuleSet:
    """Over ``parseable, has_3d, bond_lo, bond_hi, angle_hi, ring_dev, twist, clash_rel, energy_ratio, energy_ok``."""
    shown = c("parseable") & c("has_3d")
    return (
        RuleSet("pose-physical-validity")
        .rule("POSE_UNPARSEABLE", ~c("parseable"), weight=2.0)
        .rule("NO_3D_CONFORMER", c("parseable") & ~c("has_3d"), weight=2.0)
        .rule("BOND_LENGTH_OUTLIER", shown & ((c("bond_lo") < 0.75) | (c("bond_hi") > 1.25)))
        .rule("BOND_ANGLE_OUTLIER", shown & (c("angle_hi") > 1.25))
        .rule("AROMATIC_RING_NONPLANAR", shown & (c("ring_dev") > 0.25))
        .rule("DOUBLE_BOND_NONPLANAR", shown & (c("twist") > 25))
        .rule("INTERNAL_STERIC_CLASH", shown & (c("clash_rel") < 0.60), weight=1.5)
        .rule("INTERNAL_STRAIN_ENERGY", shown & c("energy_ok") & (c("energy_ratio") > 100))
        .rule("ENERGY_UNCHECKABLE", shown & ~c("energy_ok"), weight=0.0)
    )


def cofold_rules() -> RuleSet:
    """Over ``framed, min_rel, overlap_frac, min_dist``."""
    f = c("framed")
    return (
        RuleSet("cofold-intermolecular-validity")
        .rule("LIGAND_PROTEIN_CLASH", f & (c("min_rel") < 0.75), weight=1.5)
        .rule("LIGAND_PROTEIN_VOLUME_OVERLAP", f & (c("overlap_frac") > 0.075), weight=1.5)
        .rule("LIGAND_OUT_OF_POCKET", f & (c("min_dist") > 5.0))
        .rule("NOT_FRAMED", ~f, weight=0.0)
    )


def complex_rules() -> RuleSet:
    """Over ``framed, n_clash, max_overlap, buried_frac, min_dist``."""
    f = c("framed")
    return (
        RuleSet("complex-interface-validity")
        .rule("INTERFACE_CLASH", f & (c("n_clash") > 0), weight=0.0)
        .rule("SEVERE_INTERFACE_CLASH", f & (c("max_overlap") > 0.90), weight=1.5)
        .rule("INTERFACE_VOLUME_OVERLAP", f & (c("buried_frac") > 0.10), weight=1.5)
        .rule("CHAINS_NOT_IN_CONTACT", f & (c("min_dist") > 5.0))
        .rule("NOT_FRAMED", ~f, weight=0.0)
    )


def single_cell_rules() -> RuleSet:
    """Over ``knockdown_resid`` (null: unmeasured) and ``n_cells``."""
    return (
        RuleSet("perturbseq-reliability")
        .rule("WEAK_KNOCKDOWN", c("knockdown_resid") > 0.5, weight=2.0)
        .rule("KNOCKDOWN_UNMEASURED", c("knockdown_resid").isNull())
        .rule("LOW_CELL_COUNT", c("n_cells") < 25)
    )


def retro_leakage_rules() -> RuleSet:
    """Over booleans ``product_seen, same_source, reaction_seen, template_seen`` and ``similarity``."""
    return (
        RuleSet("retro-leakage")
        .rule("EXACT_PRODUCT_IN_TRAIN", c("product_seen"))
        .rule("NEAR_DUP_PRODUCT", c("similarity") >= 0.7)
        .rule("SAME_PATENT_IN_TRAIN", c("same_source"))
        .rule("REACTION_DUP", c("reaction_seen"))
        .rule("TEMPLATE_SEEN_IN_TRAIN", c("template_seen"))
    )


def molecule_leakage_rules() -> RuleSet:
    return RuleSet("molnet-leakage").rule("NEAR_DUP_MOLECULE", c("similarity") >= 0.7).rule("SCAFFOLD_SEEN_IN_TRAIN", c("scaffold_seen"))


def pair_leakage_rules() -> RuleSet:
    """Over booleans ``a_seen, b_seen, near_dup``."""
    return (
        RuleSet("ppi-leakage")
        .rule("BOTH_PARTNERS_SEEN", c("a_seen") & c("b_seen"), weight=2.0)
        .rule("PARTNER_SEEN_IN_TRAIN", c("a_seen") | c("b_seen"))
        .rule("NEAR_DUP_PROTEIN", c("near_dup"))
    )


def guide_rules(seq: str = "seq") -> RuleSet:
    """Hard rules of a guide sequence, over ``gc`` and ``max_run``."""
    return (
        RuleSet("guide-hard")
        .rule("TTTT", F.contains(F.col(seq), F.lit("TTTT")))
        .rule("GC_LOW", c("gc") < 0.20)
        .rule("GC_HIGH", c("gc") > 0.80)
        .rule("RUN", c("max_run") >= 5)
    )
