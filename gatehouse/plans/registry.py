"""The front door: a modality names a reader, a feature projection, a rule set and perhaps a verdict on the whole set."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions import antibody as ab
from gatehouse.functions import sequences as S
from gatehouse.operators import gates, geometry
from gatehouse.operators.rules import RuleSet, set_verdict
from gatehouse.sources import readers


class QualifyError(ValueError):
    """The artifact or the modality does not fit."""


@dataclass(frozen=True)
class Gate:
    modality: str
    extensions: tuple[str, ...]
    load: Callable[[SparkSession, str, dict], DataFrame]
    rules: Callable[[], RuleSet]
    batch: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class QualifyResult:
    modality: str
    items: DataFrame
    batch: DataFrame | None = None

    def verdict(self) -> DataFrame:
        """One row ``items, passed, ok`` over all items and the set as a whole."""
        return set_verdict(self.items, self.batch)

    def to_json(self) -> DataFrame:
        """One line per item: ``name, ok, clean, score, reasons``."""
        return self.items.select(F.to_json(F.struct("name", "ok", "clean", "score", "reasons")).alias("json"))


def _dna(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    if os.path.splitext(source)[1]:
        records = readers.fasta(spark, source)
    else:
        records = spark.createDataFrame([("inline", 1, "inline", source)], "file string, n int, name string, seq string")
    return readers.dna(records)


def _load_dna(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    return gates.dna_features(_dna(spark, source, opts), "seq")


def _load_promoter(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    df = gates.dna_features(_dna(spark, source, opts), "seq", scans=False).withColumn("box", S.promoter_boxes("seq"))
    return df.crossJoin(F.broadcast(gates.calibrate_promoters(df.limit(0), "seq")))  # one row


def _load_antibody(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    if os.path.splitext(source)[1]:
        df = readers.antibody_pairs(readers.fasta(spark, source)).withColumnRenamed("file", "name")
    else:
        heavy, light = readers.inline_antibody(F.lit(source))
        df = spark.range(1).select(F.lit("inline").alias("name"), heavy.alias("heavy"), light.alias("light"))
    return ab.features(df, "heavy", "light")


def _atoms(spark: SparkSession, source: str) -> DataFrame:
    return readers.cif(spark, source) if source.lower().endswith(("cif", "mmcif")) else readers.pdb(spark, source)


def _load_cofold(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    protein, ligand = readers.split_ligand(_atoms(spark, source), opts.get("ligand_resname"))
    found = geometry.ligand_features(protein, ligand).join(geometry.volume_overlap(protein, ligand), "g", "left")
    return found.withColumnRenamed("g", "name")


def _load_complex(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    protein, _ = readers.split_ligand(_atoms(spark, source))
    a, b = opts.get("chain_a"), opts.get("chain_b")
    if not (a and b):
        # the two chains with most atoms, the one seen first of equal ones
        from pyspark.sql import Window as W

        sizes = protein.groupBy("complex", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("atom").alias("first"))
        rank = F.row_number().over(W.partitionBy("complex").orderBy(F.desc("n"), "first"))
        top = sizes.withColumn("side", rank).where("side <= 2").select("complex", "chain", "side")
        protein = protein.join(top, ["complex", "chain"])
        return geometry.interface_features(protein.where("side = 1"), protein.where("side = 2")).withColumnRenamed("g", "name")
    return geometry.interface_features(protein.where(F.col("chain").isin(*a)), protein.where(F.col("chain").isin(*b))).withColumnRenamed("g", "name")


def cross_hybridization(records: DataFrame, key: str, seq: str, mild: int = gates.CROSS) -> DataFrame:
    """``a, b, stretch`` of pairs a < b that can anneal over at least ``mild`` bases.

    Candidates share a window of that length with the other's reverse complement (an equi-join); only those are measured.
    """
    own = records.select(F.col(key).alias("a"), F.explode(S.kmer_set(F.col(seq), mild)).alias("k")).where(F.length("k") == mild)
    turned = records.select(F.col(key).alias("b"), F.explode(S.kmer_set(S.reverse_complement(F.col(seq)), mild)).alias("k")).where(F.length("k") == mild)
    pairs = own.join(turned, "k").where("a < b").select("a", "b").distinct()
    left, right = records.select(F.col(key).alias("a"), F.col(seq).alias("sa")), records.select(F.col(key).alias("b"), F.col(seq).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", S.longest_common_substring("sa", S.reverse_complement(F.col("sb"))).alias("stretch"))


def _dna_batch(items: DataFrame) -> DataFrame:
    pairs = cross_hybridization(items, "name", "seq")
    counts = pairs.agg(F.count_if((F.col("stretch") < gates.CROSS_SEVERE)).alias("mild"), F.count_if(F.col("stretch") >= gates.CROSS_SEVERE).alias("severe"))
    return gates.dna_batch_rules().evaluate(counts)


def _needs_table(spark: SparkSession, source: str, opts: dict) -> DataFrame:
    """Features of molecules and poses come from chemistry software, as a table with the columns the rules read."""
    return spark.read.parquet(source)


_STRUCTURES, _FASTA = (".pdb", ".cif", ".mmcif", ".ent", ".pdbqt"), (".fasta", ".fa", ".fna")
GATES = {
    g.modality: g
    for g in (
        Gate("pose", (".pose.parquet",), _needs_table, gates.pose_rules),
        Gate("mol", (".mol.parquet",), _needs_table, gates.molecule_rules),
        Gate("dna", _FASTA, _load_dna, gates.dna_rules, _dna_batch),
        Gate("promoter", _FASTA, _load_promoter, gates.promoter_rules),
        Gate("cofold", _STRUCTURES, _load_cofold, gates.cofold_rules),
        Gate("complex", _STRUCTURES, _load_complex, gates.complex_rules),
        Gate("antibody", _FASTA[:2], _load_antibody, gates.antibody_rules),
    )
}


def modalities() -> list[str]:
    return list(GATES)


def _gate(artifact: str, modality: str | None) -> Gate:
    if modality is not None:
        if modality not in GATES:
            raise QualifyError(f"unknown modality {modality!r}; one of {', '.join(GATES)}")
        return GATES[modality]
    fits = [g for g in GATES.values() if artifact.lower().endswith(g.extensions)]
    if len(fits) == 1:
        return fits[0]
    names = ", ".join(g.modality for g in fits) or ", ".join(GATES)
    raise QualifyError(f"the modality of {artifact!r} is {'ambiguous' if fits else 'unknown'}: name one of {names}")


def qualify(spark: SparkSession, artifact: str, modality: str | None = None, **opts) -> QualifyResult:
    """Verdicts on a file, folder, glob or inline sequence: ``name``, features, ``reasons``, ``score``, ``ok``, ``clean``."""
    gate = _gate(artifact, modality)
    items = gate.load(spark, artifact, opts)
    if items.isEmpty():
        raise QualifyError(f"nothing to qualify in {artifact!r}")
    return QualifyResult(gate.modality, gate.rules().evaluate(items), gate.batch(items) if gate.batch else None)
