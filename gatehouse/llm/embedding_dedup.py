"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking by cosine.

1. Codes.  Iterative quantisation learns orthogonal rotations of the unit vectors whose signs lose as little as
   possible (alternating sign codes and a Procrustes rotation), from a bounded sample of ``sample`` vectors; several
   starts give several independent groups of bits.  The vectors are not centred: the threshold bounds their angle at
   the origin, and the chance that a bit agrees follows from it.
2. Tables.  The code is cut into substrings, one table each.  Vectors with one label, one length and an equal substring
   meet in a bucket.  The substring length grows with the logarithm of the largest label, so buckets keep their size, and
   the number of tables follows from it: enough that a pair at the threshold is missed in all tables with a probability
   below ``miss``, at the bit agreement of that angle.
3. Rerank.  In a bucket all cosines are taken in double precision from the original vectors.  A pair counts in the
   first table in which it meets, so no pair is counted twice.  A bucket reports counts per vector and a spanning forest of
   its links, never pairs.  Buckets of more than ``part_rows`` vectors are cut into parts, and every pair of parts is a
   cell: no task holds more than two parts, and of a cell's cosines only ``_PAIRS`` at a time.

Equal vectors of one label are one vertex with a multiplicity.  Components come from the forests.

Bounds: the sample for the rotations (``sample`` vectors, those with the smallest hashes); every vector is indexed.
Vectors of a length of which the sample has fewer rows than components are coded by random directions instead.

Edge cases: vectors that are null, zero or hold null or non-finite components and vectors with a null label or a null id
link with nothing (n_links 0, a component of their own); vectors of different lengths never link; repeated ids with
equal vectors link with each other, with different vectors they are two vertices; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm._scratch import Scratch
from gatehouse.llm.components import components
from gatehouse.llm.vectors import cells, matrix, usable

#: Cosines that a cell holds at a time, and the rows of one bucket that look up its size in one place.
_PAIRS, _SALTS = 1 << 16, 8


def learn_rotations(x: np.ndarray, groups: int, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """The d x (groups * d) projection by iterative quantisation of unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(x, full_matrices=x.shape[0] < x.shape[1])
    v = x @ axes.T
    found = []
    for _ in range(groups):
        r = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))[0]
        for _ in range(rounds):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(codes.T @ v)
            r = (u @ w).T
        found.append(axes.T @ r)
    return np.hstack(found)


def table_shape(largest: int, threshold: float, miss: float, fill: int = 48) -> tuple[int, int]:
    """``(bits per substring, tables)`` for ``largest`` vectors that could meet."""
    bits = max(6, math.ceil(math.log2(max(largest, 2) / fill)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))


class Coder:
    """Substrings of the code of unit vectors of any length."""

    def __init__(self, learned: dict[int, np.ndarray], bits: int, tables: int):
        self.learned, self.bits, self.tables = learned, bits, tables

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Rows x tables: the value of each substring."""
        length = unit.shape[1]
        if length not in self.learned:
            self.learned[length] = np.random.default_rng(length).standard_normal((length, self.bits * self.tables))
        codes = unit @ self.learned[length][:, : self.bits * self.tables] >= 0
        weights = (1 << np.arange(self.bits)).astype(np.int64)
        return codes.reshape(len(unit), self.tables, self.bits).astype(np.int64) @ weights


def _link_cells(threshold: float):
    def forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
        def root(x: int) -> int:
            while (up := parent[x]) != x:
                parent[x] = x = parent[up]
            return x

        # pairs that one step shows to be joined already need no walk
        apart = parent[a] != parent[b]
        edges = []
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((x, y))
        return edges

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            side, ids, times = (cell.column(name).to_numpy() for name in ("side", "node", "n"))
            unit = matrix(cell.column("vector").combine_chunks())
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            keys = matrix(cell.column("earlier").combine_chunks(), np.int64)
            own, other = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
            inner = not len(other)
            if inner:
                other = own
            count, parent, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
            step = max(1, _PAIRS // max(1, len(other)))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                near = unit[rows] @ unit[other].T >= threshold
                if inner:
                    near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                i, j = np.nonzero(near)
                i, j = rows[i], other[j]
                if keys.shape[1]:
                    # a pair counts in the first table where it meets
                    fresh = ~(keys[i] == keys[j]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                count += np.bincount(i, times[j], len(ids)).astype(np.int64)
                if not inner:
                    count += np.bincount(j, times[i], len(ids)).astype(np.int64)
                edges += forest(i, j, parent)
            rows = np.flatnonzero(count)
            first, second = np.array(edges, np.int64).reshape(-1, 2).T
            none = pa.nulls(len(rows), pa.int64())
            columns = [
                pa.concat_arrays([pa.array(ids[rows]), pa.array(ids[first])]),
                pa.concat_arrays([none, pa.array(ids[second])]),
                pa.concat_arrays([pa.array(count[rows]), pa.array(np.zeros(len(edges), np.int64))]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    return links


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.93, miss: float = 0.001, sample: int = 8192, part_rows: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    fit = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    distinct = fit.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "distinct")
    largest = distinct.groupBy("label", "length").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0]
    if not largest:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = table_shape(largest, threshold, miss)
    taken: dict[int, list] = {}
    for row in distinct.orderBy(F.xxhash64("rep"), "rep", "label", "vector").limit(sample).select("vector").collect():
        taken.setdefault(len(row["vector"]), []).append(row["vector"])
    learned = {}
    for length, few in taken.items():
        if len(few) >= length:
            x = np.array(few, dtype=np.float64)
            learned[length] = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), math.ceil(bits * tables / length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(learned, bits, tables)
        for batch in batches:
            column, keys = batch.column(0), np.zeros((batch.num_rows, tables), np.int64)
            lengths = column.value_lengths().to_numpy()
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                x = matrix(column.take(pa.array(own)))
                keys[own] = coder(x / np.linalg.norm(x, axis=1, keepdims=True))
            values = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "keys"])

    label, vector = (distinct.schema[c].dataType.simpleString() for c in ("label", "vector"))
    coded = distinct.select("vector", "label", "length", "node", "n").mapInArrow(place, f"vector {vector}, label {label}, length int, node long, n long, keys array<long>")
    coded = scratch.save(coded, "coded")
    bucket = ["label", "length", "table", "value"]
    sizes = coded.select("label", "length", F.posexplode("keys").alias("table", "value")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # sizes stand in as many copies as there are salts, so the rows of a full bucket look them up in several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    sizes = scratch.save(sizes.select(*bucket, F.ceil(F.col("m") / part_rows).cast("int").alias("parts")), "sizes").withColumn("salt", salts)
    spread = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q"),
            F.when(q == F.col("part"), 2).when(q > F.col("part"), 0).otherwise(1).alias("side"),
        ),
    )
    met = coded.select("label", "length", "vector", "node", "n", "keys", F.posexplode("keys").alias("table", "value"))
    met = met.withColumn("earlier", F.slice("keys", F.lit(1), F.col("table"))).drop("keys").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int"))
    met = met.join(sizes, [*bucket, "salt"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("c", F.explode(spread))
    # JSON keeps labels apart whatever they hold
    cell = F.to_json(F.struct(*bucket, "c.p", "c.q"))
    dealt = met.select(cell.alias("cell"), "c.side", "node", "n", "earlier", "vector").repartition("cell").sortWithinPartitions("cell")
    found = scratch.save(dealt.mapInArrow(_link_cells(threshold), "a long, b long, n long"), "found")
    scratch.drop(coded)
    counted = found.where("b is null").groupBy(F.col("a").alias("c_node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "member")
    named = distinct.join(groups, F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("head"))
    whole = (
        named.join(heads, F.col("component") == F.col("c"))
        .join(counted, F.col("node") == F.col("c_node"), "left")
        .select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), "head")
    )
    whole = scratch.save(whole, "whole")
    out = rows.join(whole, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")) & F.col("id").isNotNull(), "left")
    head = F.coalesce("head", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), head.alias("component_id"), F.col("id").eqNullSafe(head).alias("kept")
    )
