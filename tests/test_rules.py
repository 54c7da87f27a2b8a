from pyspark.sql import functions as F

from gatehouse.functions import antibody
from gatehouse.operators import gates, rules


def test_order_weights_and_disclosure(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, x int")
    rs = rules.RuleSet("t").rule("BIG", F.col("x") > 10, weight=1.5).rule("ANY", F.col("x") > 0, "a note: x", 0.0, rules.CALIBRATED)
    got = {r.id: r for r in rs.evaluate(df).collect()}
    assert (got[1].ok, got[1].clean, got[1].fired, got[1].messages, got[1].score) == (True, False, ["ANY"], ["a note: x"], 0.0)
    assert (got[2].ok, got[2].fired, got[2].score) == (False, ["BIG", "ANY"], 1.5)
    assert (got[3].ok, got[3].clean) == (True, True)
    assert rs.hard_only().names == ["BIG"] and rs.hard_only().name == "t[hard]"
    assert rules.RuleSet("none").evaluate(df).where("clean").count() == 3


def test_dna_rules_fire_one_by_one(spark):
    clean = "ACGTTGCATCAGGATCTACGACTGATCGTACTTGACCATGCAAGTCTGAGCATTAGCCTA"
    cases = {
        "GC_OUT_OF_BAND": "AT" * 30, "HOMOPOLYMER_RUN": clean[:20] + "A" * 9 + clean[20:], "LENGTH_OUT_OF_RANGE": "ACGTTGCATC",
        "STRONG_HAIRPIN": "ACGTTGCATCAGGA" + "TTTTT" + "TCCTGATGCAACGT" + clean[:20], "POLY_G_RUN": clean[:20] + "GGGG" + clean[20:], "RESTRICTION_SITE": clean[:20] + "GAATTC" + clean[20:],
    }
    df = spark.createDataFrame([("clean", clean), *cases.items()], "name string, seq string")
    got = {r.name: r for r in gates.dna_rules().evaluate(gates.dna_features(df, "seq")).collect()}
    assert got["clean"].fired == []
    for name in cases:
        assert name in got[name].fired, name
    assert got["POLY_G_RUN"].ok and got["RESTRICTION_SITE"].ok


# The variable domains of a published antibody.
HEAVY = "EVQLVESGGGLVQPGGSLRLSCAASGFNIKDTYIHWVRQAPGKGLEWVARIYPTNGYTRYADSVKGRFTISADTSKNTAYLQMNSLRAEDTAVYYCSRWGGDGFYAMDYWGQGTLVTVSS"
LIGHT = "DIQMTQSPSSLSASVGDRVTITCRASQDVNTAVAWYQQKPGKAPKLLIYSASFLYSGVPSRFSGSRSGTDFTLTISSLQPEDFATYYCQQHYTTPPTFGQGTKVEIK"


def test_antibody_rules(spark):
    odd = HEAVY.replace("DGFYAMDY", "DCFYAMDY")
    sequon = HEAVY.replace("DGFYAMDY", "DNISAMDY")
    df = spark.createDataFrame([("ok", HEAVY, LIGHT), ("odd", odd, LIGHT), ("sequon", sequon, LIGHT), ("single", HEAVY, None), ("junk", "ACD", None)], "name string, h string, l string")
    got = {r.name: r for r in gates.antibody_rules().evaluate(antibody.features(df, "h", "l")).collect()}
    assert got["ok"].ok and got["ok"].cdr_ok and got["ok"].h3_len == 11
    assert "UNPAIRED_CYSTEINE" in got["odd"].fired and "N_GLYCOSYLATION_SEQUON_CDR" in got["sequon"].fired
    assert got["single"].cdr_ok and not got["single"].has_light
    assert "CDR_DETECTION_UNCERTAIN" in got["junk"].fired and got["junk"].h3_len is None


def test_feature_table_rules(spark):
    row = {"valid": True, "sa": 7.0, "mw": 950.0, "logp": 6.0, "hbd": 1, "hba": 2, "rotb": 11, "tpsa": 10.0, "n_alerts": 1}
    bad = row | {"valid": False}
    got = gates.molecule_rules().evaluate(spark.createDataFrame([row, bad])).select("fired").collect()
    assert got[0].fired == ["UNSYNTHESIZABLE", "EXTREME_PROPERTY", "STRUCTURAL_ALERT", "LIPINSKI_RO5", "VEBER"]
    assert got[1].fired == ["INVALID_MOLECULE"]
    pose = {"parseable": True, "has_3d": True, "bond_lo": 0.7, "bond_hi": 1.0, "angle_hi": 1.3, "ring_dev": 0.3, "twist": 30.0, "clash_rel": 0.5, "energy_ratio": 200.0, "energy_ok": False}
    got = gates.pose_rules().evaluate(spark.createDataFrame([pose])).first()
    assert got.fired == ["BOND_LENGTH_OUTLIER", "BOND_ANGLE_OUTLIER", "AROMATIC_RING_NONPLANAR", "DOUBLE_BOND_NONPLANAR", "INTERNAL_STERIC_CLASH", "ENERGY_UNCHECKABLE"]
