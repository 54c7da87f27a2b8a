"""Readers: sequence, structure and screen files as DataFrames, through Spark's own file sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """The input cannot be read as what it should be."""


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, name, seq``: one row per record; the name is the header's first word, or ``seq`` and the number of records before it."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    records = text.select("file", F.posexplode(F.split("value", "(?m)^>")).alias("n", "record")).where("n > 0")
    head = F.split("record", "\\r?\\n", 2)
    name = F.regexp_extract(F.get(head, F.lit(0)), r"^\s*(\S*)", 1)
    body = F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "")
    return records.select("file", "n", F.when(name == "", F.concat(F.lit("seq"), F.col("n") - 1)).otherwise(name).alias("name"), body.alias("seq"))


def dna(records: DataFrame) -> DataFrame:
    """Upper-case records without spaces; an empty or foreign sequence is an error that names it."""
    clean = F.upper(F.regexp_replace("seq", r"\s", ""))
    bad = F.raise_error(F.concat(F.lit("not a DNA sequence: "), F.col("name")))
    return records.withColumn("seq", F.when(clean.rlike("^[ACGT]+$"), clean).otherwise(bad))


def smiles(spark: SparkSession, path: str) -> DataFrame:
    """``smiles, name`` per line; blank lines and comments are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.get(parts, F.lit(0)).alias("smiles"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("name"))


# What a header says of a chain, as parts of it or as the whole of it.
HEAVY_PARTS, HEAVY_NAMES, LIGHT_PARTS, LIGHT_NAMES = "heavy|vhh|vh|hc", ["h"], "light|vl|kappa|lambda|lc", ["l", "k"]


def antibody_pairs(records: DataFrame) -> DataFrame:
    """``file, heavy, light``: the first chain of each role by its header, the places left filled by the others in order.

    A lone chain is heavy.  A chosen chain that is empty or holds a foreign letter is an error that names it.
    """
    low = F.lower("name")
    heavy = low.rlike(HEAVY_PARTS) | low.isin(HEAVY_NAMES)
    role = F.when(heavy, "H").when(low.rlike(LIGHT_PARTS) | low.isin(LIGHT_NAMES), "L")
    chains = F.array_sort(F.collect_list(F.struct("n", role.alias("role"), "seq")))
    g = records.groupBy("file").agg(chains.alias("all"))
    first = lambda r: F.get(F.filter("all", lambda x: x["role"] == r), F.lit(0))
    g = g.withColumn("h", first("H")).withColumn("l", first("L"))
    named = F.array(F.coalesce(F.col("h.n"), F.lit(-1)), F.coalesce(F.col("l.n"), F.lit(-1)))
    g = g.withColumn("rest", F.filter("all", lambda x: ~F.array_contains(named, x["n"])))
    second = F.get("rest", F.when(F.col("h").isNull(), 1).otherwise(0))["seq"]
    both = g.select("file", F.coalesce("h.seq", F.get("rest", F.lit(0))["seq"]).alias("heavy"), F.coalesce("l.seq", second).alias("light"))

    def checked(chain: str) -> Column:
        clean = F.upper(F.regexp_replace(chain, r"\s", ""))
        bad = F.raise_error(F.concat(F.lit(f"not an amino acid sequence: {chain} chain of "), F.col("file")))
        return F.when(F.col(chain).isNull() | clean.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), clean).otherwise(bad).alias(chain)

    return both.select("file", checked("heavy"), checked("light"))


def inline_antibody(value: Column) -> tuple[Column, Column]:
    """``HEAVY:LIGHT`` as two columns; no colon, no light chain."""
    parts = F.split(value, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def _with_element(lines: DataFrame) -> DataFrame:
    declared = F.initcap(F.trim(F.substring("value", 77, 2)))
    name = F.trim(F.substring("value", 13, 4))
    letters = F.substring(F.regexp_replace(name, "[^A-Za-z]", ""), 1, 2)
    guessed = F.when((F.length(letters) == 2) & F.substring(letters, 2, 1).rlike("[A-Z]") & name.rlike("^[A-Za-z]"), F.substring(letters, 1, 1)).otherwise(letters)
    return lines.withColumn("element", F.when(declared != "", declared).otherwise(F.initcap(guessed)))


def pdb(spark: SparkSession, path: str, heavy_only: bool = True) -> DataFrame:
    """``complex, atom, element, x, y, z, resname, is_hetero, chain, atom_name, resnum`` from fixed columns.

    Lines whose coordinates are no numbers are dropped; with ``heavy_only`` hydrogens and unknown elements too.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("complex"), F.posexplode(F.split("value", "\\r?\\n")).alias("atom", "value"))
    record = F.trim(F.substring("value", 1, 6))
    lines = _with_element(lines.where(record.isin("ATOM", "HETATM")))
    number = lambda start, n: F.trim(F.substring("value", start, n)).try_cast("double")
    text = lambda start, n: F.trim(F.substring("value", start, n))
    atoms = lines.select(
        "complex", "atom", "element", number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), text(18, 3).alias("resname"),
        (F.trim(F.substring("value", 1, 6)) == "HETATM").alias("is_hetero"), text(22, 1).alias("chain"), text(13, 4).alias("atom_name"),
        text(23, 4).try_cast("int").alias("resnum"),
    ).where("x is not null and y is not null and z is not null")
    return atoms.where(~F.col("element").isin("H", "D", "")) if heavy_only else atoms


def cif(spark: SparkSession, path: str, heavy_only: bool = True) -> DataFrame:
    """The atoms of an mmCIF file's ``_atom_site`` loop, in the columns of ``pdb``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["complex"], batch["value"], strict=True):
                columns, rows, inside = [], [], False
                for line in text.splitlines():
                    if line.startswith("_atom_site."):
                        columns.append(line.strip().split(".", 1)[1].split()[0])
                        inside = True
                    elif inside and line[:4] in ("ATOM", "HETA"):
                        rows.append(line.split())
                    elif inside and rows:
                        break
                at = {c: i for i, c in enumerate(columns)}
                out = []
                for n, row in enumerate(r for r in rows if len(r) == len(columns)):
                    get = lambda *names, row=row: next((row[at[c]].strip("\"'") for c in names if c in at), "")
                    try:
                        x, y, z = (float(get(f"Cartn_{k}")) for k in "xyz")
                    except ValueError:
                        continue
                    element, number = get("type_symbol").capitalize(), get("auth_seq_id", "label_seq_id")
                    if heavy_only and element in ("H", "D", ""):
                        continue
                    out.append((name, n, element, x, y, z, get("label_comp_id", "auth_comp_id"), get("group_PDB") == "HETATM",
                                get("auth_asym_id", "label_asym_id"), get("label_atom_id"), int(number) if number.lstrip("-").isdigit() else None))
                frame = pd.DataFrame(out, columns="complex atom element x y z resname is_hetero chain atom_name resnum".split())
                yield frame.astype({"resnum": "Int32"})

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("complex"), "value")
    return whole.mapInPandas(parse, "complex string, atom int, element string, x double, y double, z double, resname string, is_hetero boolean, chain string, atom_name string, resnum int")


# Residues of proteins, and what counts as solvent.
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL HID HIE HIP CYX ASH GLH LYN".split()
SOLVENT = "HOH WAT DOD TIP SOL".split()


def split_ligand(atoms: DataFrame, ligand: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(protein, ligand)``: by the ligand's residue name if given, else by standard residues and solvent."""
    name = F.upper("resname")
    if ligand is not None:
        return atoms.where(name != ligand.upper()), atoms.where(name == ligand.upper())
    standard = name.isin(STANDARD) & ~F.col("is_hetero")
    return atoms.where(standard), atoms.where(~standard & ~name.isin(SOLVENT))


def counts(spark: SparkSession, path: str, initial: str = "initial", final: str = "final") -> DataFrame:
    """A screen's count table as ``guide, gene, sample, arm, n``: guide, gene, then a column per sample.

    The separator comes from the header line; an arm from the sample's name; rows with a count that is no integer go.
    """
    header = spark.read.text(path).first()
    if header is None:
        raise SourceError(f"empty table: {path}")
    sep = "\t" if "\t" in header[0] else ","
    wide = spark.read.csv(path, header=True, sep=sep)
    guide, gene, *samples = wide.columns
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").try_cast("long").alias("n")) for s in samples]))
    whole = wide.where(~F.exists(F.array(*[F.col(f"`{s}`").try_cast("long") for s in samples]), lambda x: x.isNull()))
    long = whole.select(F.col(f"`{guide}`").alias("guide"), F.upper(F.col(f"`{gene}`")).alias("gene"), cells.alias("c")).select("guide", "gene", "c.*")
    low = F.lower("sample")
    arm = F.when(F.contains(low, F.lit(initial)), "initial").when(F.contains(low, F.lit(final)), "final")
    return long.withColumn("arm", arm).where("arm is not null").select("guide", "gene", "sample", "arm", "n")


# Accepted names of a user screen's columns, in order of preference, and names of control targets.
ALIASES = {
    "target": ("target", "gene", "target_gene", "gene_symbol", "symbol"),
    "knockdown_resid": ("knockdown_residual", "residual_expression", "residual_expr", "residual", "fold_expr", "fold_change", "knockdown"),
    "p": ("energy_p", "energy_test_p_value", "phenotype_pvalue", "phenotype_p", "pvalue", "p_value", "pval", "p"),
    "n_cells": ("n_cells", "num_cells", "ncells", "cells", "num_cells_unfiltered"),
    "control": ("is_control", "control", "core_control", "non_targeting", "nt"),
}
CONTROL_TARGETS = ["non-targeting", "non_targeting", "nontargeting", "nt", "control", "neg", "negative", "safe-harbor", "safe_harbor"]
TRUE_WORDS = ["1", "true", "yes", "y", "t"]
MISSING_CELLS = 2**31 - 1


def user_screen(spark: SparkSession, path: str) -> DataFrame:
    """``target, knockdown_resid, p, n_cells, is_control`` from a table with any of the accepted headers.

    NA tokens become null; a missing p-value in a row is an error; an absent cell count never trips the floor.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise SourceError(f"empty table: {path}")
    raw = spark.read.csv(path, header=True, sep="\t" if "\t" in first[0] else ",")
    lower = {c.strip().lower(): c for c in raw.columns}
    found = {field: next((lower[a] for a in names if a in lower), None) for field, names in ALIASES.items()}
    for needed in ("target", "p"):
        if found[needed] is None:
            raise SourceError(f"no column for {needed}; one of {', '.join(ALIASES[needed])} is needed")

    def number(field: str) -> Column:
        value = F.trim(F.col(f"`{found[field]}`"))
        return F.when(~F.lower(value).isin("", "na", "nan", "none", "null"), value.cast("double"))

    target = F.trim(F.col(f"`{found['target']}`"))
    p = F.coalesce(number("p"), F.raise_error(F.concat(F.lit("no p-value for "), target)).cast("double"))
    # a control column decides alone; without one the target's name does
    control = F.lower(F.trim(F.col(f"`{found['control']}`"))).isin(TRUE_WORDS) if found["control"] else F.lower(target).isin(CONTROL_TARGETS)
    return raw.select(
        target.alias("target"), (number("knockdown_resid") if found["knockdown_resid"] else F.lit(None).cast("double")).alias("knockdown_resid"), p.alias("p"),
        F.coalesce(number("n_cells") if found["n_cells"] else F.lit(None), F.lit(float(MISSING_CELLS))).cast("int").alias("n_cells"),
        F.coalesce(control, F.lit(False)).alias("is_control"),
    )


def reactant_signature(left: Column) -> Column:
    """Reactants without atom numbers, in order."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(left, r":\d+", ""), r"\.")), ".")


def reactions(df: DataFrame, smiles_col: str) -> DataFrame:
    """``product`` and ``reactant_sig`` of a reaction ``reactants>agents>product``."""
    parts = F.split(smiles_col, ">")
    return df.withColumn("product", F.regexp_replace(F.get(parts, F.lit(2)), r":\d+", "")).withColumn("reactant_sig", reactant_signature(F.get(parts, F.lit(0))))


def workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """``file, row, cells (column letter -> text)`` of a spreadsheet's sheet, streamed row by row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                book, shared, out = zipfile.ZipFile(io.BytesIO(content)), [], []
                if "xl/sharedStrings.xml" in book.namelist():
                    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                        if tag(e) == "si":
                            shared.append("".join(t.text or "" for t in e.iter() if tag(t) == "t"))
                for _, e in ElementTree.iterparse(book.open(f"xl/worksheets/sheet{sheet}.xml")):
                    if tag(e) != "row":
                        continue
                    cells = {}
                    for c in e:
                        text = "".join(v.text or "" for v in c.iter() if tag(v) in ("v", "t"))
                        cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" and text else text
                    out.append((name, int(e.get("r", len(out) + 1)), cells))
                    e.clear()
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, row int, cells map<string,string>")


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """``gene``: the first column of a table with a header, upper case; blank names are skipped."""
    header = spark.read.text(path).first()
    if header is None:
        raise SourceError(f"empty table: {path}")
    first = spark.read.csv(path, header=True, sep="\t" if "\t" in header[0] else ",")
    name = F.upper(F.trim(F.col(f"`{first.columns[0]}`")))
    return first.select(name.alias("gene")).where(F.coalesce(F.col("gene"), F.lit("")) != "").distinct()


def reference_genes(spark: SparkSession, path: str, assayed: DataFrame) -> DataFrame:
    """The genes of a list that the screen holds."""
    return gene_list(spark, path).join(assayed.select("gene").distinct(), "gene", "left_semi")


def pairs(spark: SparkSession, positive: str, negative: str, dictionary: str) -> DataFrame:
    """``a, b, label, a_seq, b_seq`` from two tables of id pairs and one of ids and sequences, tab-separated without headers.

    Pairs of which an end has no sequence go; of an id with several sequences the smallest is taken.
    """
    table = lambda path, names: spark.read.csv(path, sep="\t").toDF(*names)
    both = table(positive, ["a", "b"]).withColumn("label", F.lit(1)).unionByName(table(negative, ["a", "b"]).withColumn("label", F.lit(0)))
    known = table(dictionary, ["id", "seq"]).groupBy("id").agg(F.min(F.upper(F.trim("seq"))).alias("seq")).where("seq <> ''")
    for end in "ab":
        both = both.join(known.toDF(f"_{end}", f"{end}_seq"), F.trim(end) == F.col(f"_{end}")).drop(f"_{end}")
    return both.select("a", "b", "label", "a_seq", "b_seq")


def sequence_values(spark: SparkSession, path: str, seq: str, value: str, study: str | None = None) -> DataFrame:
    """``seq, value, study`` of a table with a header; rows whose value is no finite number or whose sequence is no DNA go."""
    header = spark.read.text(path).first()
    if header is None:
        raise SourceError(f"empty table: {path}")
    raw = spark.read.csv(path, header=True, sep="\t" if "\t" in header[0] else ",")
    for needed in filter(None, (seq, value, study)):
        if needed not in raw.columns:
            raise SourceError(f"no column {needed} in {path}")
    number = F.trim(F.col(f"`{value}`")).try_cast("double")
    rows = raw.select(F.upper(F.regexp_replace(F.col(f"`{seq}`"), r"\s", "")).alias("seq"), number.alias("value"), (F.col(f"`{study}`") if study else F.lit(None).cast("string")).alias("study"))
    return rows.where(F.col("seq").rlike("^[ACGT]+$") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def deepest(df: DataFrame, depth: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the greatest depth, ties by key."""
    return df.orderBy(F.desc_nulls_last(depth), key).limit(n)


def oriented(df: DataFrame, label: str, scores: list[str], least: int = 10) -> DataFrame:
    """``df`` with ``label`` turned round if most scores fall as it rises; scores with fewer than ``least`` rows do not vote."""
    votes = [F.when(F.count(F.when(F.col(label).isNotNull(), F.col(s))) >= least, F.signum(F.covar_pop(s, label))).otherwise(0.0) for s in scores]
    sign = df.agg(F.when(sum(votes[1:], votes[0]) < 0, -1.0).otherwise(1.0).alias("_sign"))
    return df.crossJoin(F.broadcast(sign)).withColumn(label, F.col(label) * F.col("_sign")).drop("_sign")  # one row


def clash_list(spark: SparkSession, path: str) -> DataFrame:
    """``file, cid, a, b``: clashes of a validation report (XML) of which both ends are named as ``chain:resnum:resname:atom``."""
    from gatehouse.operators.geometry import clash_ends

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for batch in batches:
            out = []
            for name, text in zip(batch["file"], batch["value"], strict=True):
                for group in ElementTree.fromstring(text).iter("ModelledSubgroup"):
                    head = ":".join(group.get(k, "") for k in ("chain", "resnum", "resname"))
                    out += [(name, c.get("cid"), f"{head}:{c.get('atom', '')}") for c in group.iter("clash")]
            yield pd.DataFrame(out, columns=["file", "c", "end"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    ends = whole.mapInPandas(rows, "file string, c string, end string").withColumn("cid", F.struct("file", "c"))
    return clash_ends(ends.select("cid", "end")).select("cid.file", F.col("cid.c").alias("cid"), "a", "b")
