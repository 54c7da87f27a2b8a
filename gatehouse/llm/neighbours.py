"""Approximate nearest neighbours by learned partitions.

Index: on a bounded sample of ``sample`` vectors the exact neighbour graph is built and cut into balanced parts (seeded
by capacity-bound clustering, refined by moving vertices to the part that holds most of their neighbours while
sizes stay balanced).  A small classifier, one hidden layer trained on each vertex and the parts its neighbours are
in, learns to name the parts.  Every row of the table goes to its most probable part.

Search: a query goes to its most probable parts, as many as reached ``recall`` for held-back sample queries against
brute force; there all rows are reranked by inner product in double precision.  A part is cut into blocks of rows, so
no task holds more than a block, through which the queries stream; a block passes on only its ``k`` best rows per query.
Parts have ``part_rows`` rows: with fewer, what the parts pass on outgrows what their search saves.

Only vectors of one length have an inner product, so every length is an index of its own.  Lengths with fewer than
``share`` of all rows (or with less than two parts' worth of rows) have one part, which is searched whole.

Bounds: at most ``sample`` vectors (those with the smallest hashes) fit the index, 64 for each part or more, so there
are at most ``sample / 64`` parts (1,024) and blocks multiply beyond that; all rows are indexed.

Edge cases: vectors that are null, zero or hold null or non-finite components and rows with a null id take no part; of
equal vectors the ``k + 1`` smallest ids are searched, as no more can be among the nearest; fewer candidates than ``k``
are all returned, since a small table has one part; rows equal in id and vector count as one row; of rows with one id and
different vectors each is a row of its own, and each query among them is answered; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm._scratch import Scratch
from gatehouse.llm.vectors import matrix, usable


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Rows x k: the other rows with the largest inner products."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, k, axis=1)[:, :k])
    return np.vstack(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 0.1) -> np.ndarray:
    """A part per vertex: few cut edges, sizes within ``slack`` of equal."""
    n, room = len(x), int(np.ceil(len(x) / parts * (1 + slack)))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(10):
        near = x @ centres.T
        sizes, order = np.zeros(parts, np.int64), np.argsort(-near.max(axis=1), kind="stable")
        ranked = np.argsort(-near, axis=1)
        for v in order.tolist():
            for p in ranked[v].tolist():
                if sizes[p] < room:
                    part[v] = p
                    sizes[p] += 1
                    break
        centres = np.vstack([x[part == p].mean(axis=0) if sizes[p] else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(8):
        moved = 0
        for v in rng.permutation(n).tolist():
            votes = np.bincount(part[graph[v]], minlength=parts)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[v]] and sizes[best] < room:
                sizes[part[v]] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, dims: int, parts: int, hidden: int, rng: np.random.Generator):
        self.w1, self.b1 = rng.standard_normal((dims, hidden)) / np.sqrt(dims), np.zeros(hidden)
        self.w2, self.b2 = rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, rate: float = 3e-3) -> None:
        """Cross-entropy to soft targets by Adam."""
        state = [np.zeros_like(p) for p in (self.w1, self.b1, self.w2, self.b2) for _ in range(2)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                hidden = np.maximum(x[rows] @ self.w1 + self.b1, 0)
                z = hidden @ self.w2 + self.b2
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (g @ self.w2.T) * (hidden > 0)
                step += 1
                for i, grad in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ g, g.sum(axis=0))):
                    m, v = state[2 * i], state[2 * i + 1]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    (self.w1, self.b1, self.w2, self.b2)[i][...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def learn_index(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 0) -> tuple[Router, int]:
    """The router and how many parts a query must see."""
    rng = np.random.default_rng(seed)
    if parts == 1:
        return Router(x.shape[1], 1, 1, rng), 1
    held = rng.permutation(len(x))[: max(64, len(x) // 10)]
    rest = np.setdiff1d(np.arange(len(x)), held)
    base = x[rest]
    graph = neighbour_graph(base, min(10, len(base) - 1))
    part = balanced_parts(base / np.linalg.norm(base, axis=1, keepdims=True), graph, parts, rng)
    target = 0.5 * np.eye(parts)[part]
    np.add.at(target, (np.repeat(np.arange(len(base)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    router = Router(x.shape[1], parts, 4 * x.shape[1], rng)
    scale = np.sqrt(x.shape[1])
    router.w1 *= scale / max(np.abs(x).mean() * x.shape[1], 1e-12)
    router.fit(base, target, rng)
    where = np.argmax(router.scores(base), axis=1)
    near = x[held] @ base.T
    best = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
    ranks = np.argsort(np.argsort(-router.scores(x[held]), axis=1), axis=1)
    seen = np.take_along_axis(ranks, where[best], axis=1)
    for probes in range(1, parts + 1):
        if (seen < probes).mean() >= recall:
            return router, probes
    return router, parts


def _best(x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(query, row, score)`` of the ``k`` best rows of each query, ties to the smaller id; rows are sorted by id."""
    s = asked @ x.T
    s[own[:, None] == nodes[None, :]] = -np.inf
    keep = min(k, s.shape[1])
    # all ties at the k-th place stay in until the ids decide
    floor = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
    i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(own)))[i]
    i, j = i[place < k], j[place < k]
    return i, j, s[i, j]


def _search(k: int):
    """Batches sorted by cell, a cell's rows before its queries: only the rows are held."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                if names[a] != cell:
                    cell, held, ready = names[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ids = rows.column("id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    ready = matrix(rows.column("vector").combine_chunks())[order], ids[order], rows.column("node").to_numpy()[order]
                    held = []
                for at in range(a, b, 256):
                    asked = batch.slice(at, min(256, b - at))
                    own, query = asked.column(2).to_numpy(), asked.column(3).to_numpy()
                    i, j, score = _best(*ready, matrix(asked.column(4)), own, k)
                    columns = [own[i], query[i], ready[1][j], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["own", "query_id", "vec_id", "score"])

    return search


def _plan(base: DataFrame, k: int, recall: float, sample: int, part_rows: int, share: float) -> tuple[dict[int, tuple[Router, int, int]], int]:
    """Router, number of parts to see and rows for each large length, and the rows of the largest of the other lengths."""
    sizes = base.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    least = max(2 * part_rows, share * total)
    # at most 1 / share lengths are large
    large = {r["length"]: r["rows"] for r in sizes.where(F.col("rows") >= least).collect()}
    rest = sizes.where(F.col("rows") < least).agg(F.max("rows")).first()[0] or 0
    found = {}
    for length, rows in sorted(large.items()):
        parts = min(rows // part_rows, sample // 64)
        few = max(4096, 64 * parts)
        taken = base.where(F.size("vector") == length).orderBy(F.xxhash64("id"), "id").limit(min(few, sample)).select("vector").collect()
        parts = min(parts, len(taken) // 64)
        if parts > 1:
            router, probes = learn_index(np.array([r["vector"] for r in taken], dtype=np.float64), parts, k, recall)
            found[length] = router, probes, -(-rows // parts)
        else:
            rest = max(rest, rows)
    return found, rest


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, sample: int = 65_536, part_rows: int = 4000,
    block_rows: int = 20_000, share: float = 0.01, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of each query row, itself aside."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull()).groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    rows = scratch.save(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    nth = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    base = scratch.save(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("node", "id", "vector"), "base")
    plan, rest = _plan(base, k, recall, sample, part_rows, share)
    blocks = {length: max(1, -(-rows // block_rows)) for length, (_, _, rows) in plan.items()}
    rest_blocks = max(1, -(-rest // block_rows))
    names = ["cell", "asks", "node", "id", "vector"]

    def route(asks: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column(2).value_lengths().to_numpy()
                for length in np.unique(lengths).tolist():
                    own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                    node = own.column(0).to_numpy()
                    router, probes, _ = plan.get(length, (None, 1, 0))
                    n = blocks.get(length, rest_blocks)
                    best = np.zeros((len(node), 1), np.int64)
                    if router is not None:
                        scores = router.scores(matrix(own.column(2)))
                        best = np.argsort(-scores, axis=1, kind="stable")[:, : probes if asks else 1].astype(np.int64)
                    if asks:  # to every block of each part
                        cell = (best[:, :, None] * n + np.arange(n)).reshape(len(node), -1)
                    else:  # to one block
                        cell = best * n + (node % n)[:, None]
                    take = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
                    label = pa.array([f"{length}/{c}" for c in cell.ravel().tolist()])
                    columns = [label, pa.array(np.full(cell.size, asks)), *(own.column(c).take(take) for c in range(3))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows

    vector = rows.schema["vector"].dataType.simpleString()
    shape = f"cell string, asks boolean, node long, id long, vector {vector}"
    asked = rows.where("asks").select("node", "id", "vector").mapInArrow(route(True), shape)
    dealt = asked.union(base.mapInArrow(route(False), shape)).repartition("cell").sortWithinPartitions("cell", "asks")
    found = dealt.mapInArrow(_search(k), "own long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
