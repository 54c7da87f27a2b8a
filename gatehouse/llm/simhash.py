"""SimHash near-duplicates, found with BK-trees over shards of the fingerprints.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with repeats (fewer words: the
whole sequence as one shingle), XXH64 with seed 42 of the space-joined shingle; a bit is 1 if it is set in more than
half of the hashes; no words: zero.  Two documents are linked when their fingerprints differ in at most ``radius``
bits; ``component_id`` is the smallest id reachable over links.

Search: only distinct fingerprints take part.  The 64 bits are cut into ``radius + 2`` blocks; two fingerprints
within the radius agree in at least two whole blocks, so each pair meets in a shard named by two blocks and their
values.  Every shard builds its BK-tree (children keyed by the integer distance to the parent) and queries follow
only the edges within the radius.  A shard of more than ``shard_rows`` fingerprints is split into parts; each part's
tree is then sent to every part of the same shard as a cell of its own, so a dense neighbourhood spreads over tasks
and no pair is lost.  A cell reports a spanning forest of its links, at most one edge less than its members, since
reachability is all that the components need.

Trees are sent to the tasks that can have an answer in them, not to all tasks: broadcasting every shard to every
query would compare each fingerprint with each shard and grow with the square of the corpus.

Similarity: with ``similarity`` set, links are pairs whose shingle sets have at least that Jaccard similarity.
Fingerprints do not propose them: at 0.8 they differ in 14 bits of 64 or more, which no affordable number of samples
of the bits finds in a large corpus.  Min-wise hashes do: a text has ``bands`` keys of ``_PER_BAND`` minima each, and a
pair of similarity s shares a key with a probability that depends on s alone, so recall does not fall with the corpus.
``bands`` follows from the probability ``miss`` that a pair exactly at the similarity shares none.  The texts that share
a key propose a star, and every edge is checked exactly on the shingle sets of both texts.

A star spans its group before the check, so links between two of its leaves can be lost with the edges that fail.
Hence a second step: texts that proposals connect form a family, and where the edges that held leave a family in more
than one piece, all its pairs across pieces are compared exactly.  Large families are split into parts of ``shard_rows``
texts that meet in cells as above; families that are in one piece already, like a large group of close copies, take no
part.  So only pairs whose texts no chain of proposals connects can be missed.

There the vertices are distinct texts by the digest of their words: texts of one repeated phrase can share a fingerprint
and differ in all the rest.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows share a
fingerprint, hence a component; rows with a null id are fingerprinted but never name a component unless no row of
it has an id; an empty table gives an empty result; other columns pass through, except those named like a result
column, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm._scratch import Scratch, meet
from gatehouse.llm.components import chained, components
from gatehouse.llm.vectors import cells

SEED = 42
SHINGLE = 3
_CHUNK = 1 << 16  # shingle hashes held at a time
_PER_BAND = 6  # min-wise hashes that agree in a band
_TASK_ROWS = 20_000  # fingerprints that a task sorts out


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, most significant first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def _shingles(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, so many at a time; nothing without words."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in _shingles(_words(text), width):
        total, n = total + _bit_counts(hashes), n + len(hashes)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return rows


def with_fingerprints(docs: DataFrame, columns: list[tuple[Column, str]], text: Column, width: int = SHINGLE) -> DataFrame:
    """The named columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    rows = docs.select(*[c.alias(n) for c, n in columns], text.alias("_text"))
    return rows.mapInArrow(_fingerprints(width), T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a new value and return its node."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes whose value differs from ``value`` in at most ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high, below = d - radius, d + radius, children[at]
            if len(below) <= 2 * radius + 1:
                todo += [n for k, n in below.items() if low <= k <= high]
            else:
                todo += [below[k] for k in range(low, high + 1) if k in below]
        return found


def _forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left``, or between ``left`` and ``right``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]  # halves the path
        return x

    edges, tree = [], BKTree()
    if right is not None:
        for v in left:
            tree.add(v)
    for v in left if right is None else right:
        for n in tree.within(v, radius):
            a, b = root(tree.values[n]), root(v)
            if a != b:
                parent[a] = b
                edges.append((tree.values[n], v))
        if right is None:
            tree.add(v)
    return edges


def _cell_links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            side = cell.column("side").to_numpy()
            values = cell.column("fp").to_numpy().view(np.uint64)
            other = np.unique(values[side == 1]).tolist() if (side == 1).any() else None
            edges = _forest(np.unique(values[side != 1]).tolist(), other, radius)
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return links


def _spread() -> Column:
    """The cells of a row of ``part`` out of ``parts``: in cell (p, q), p <= q, the tree of part p meets part q."""
    return F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q"),
            F.when(q == F.col("part"), 2).when(q > F.col("part"), 0).otherwise(1).alias("side"),
        ),
    )


def _shards(prints: DataFrame, radius: int, shard_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(cell, side, fp)``, each fingerprint in every cell where a partner could be; and how many such rows there are."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, j in combinations(range(blocks), 2):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in (i, j))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i * blocks + j).cast("int").alias("kind"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.kind", "k.value")
    sizes = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int")), "sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    # fingerprints alone in their shard have no partner there
    sizes = sizes.select(F.col("kind").alias("k"), F.col("value").alias("v"), "parts")
    rows = meet(rows, sizes, [("kind", "k"), ("value", "v")], "fp")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.select("kind", "value", "fp", F.explode(_spread()).alias("c"))
    return rows.select(F.concat_ws("/", "kind", "value", "c.p", "c.q").alias("cell"), F.col("c.side").alias("side"), "fp"), total


def link_fingerprints(prints: DataFrame, scratch: Scratch, radius: int = 2, shard_rows: int = 512) -> DataFrame:
    """Edges ``(a, b)`` over distinct ``fp`` values that span the same components as all links do."""
    dealt, total = _shards(prints, radius, shard_rows, scratch)
    # the rows are few bytes and much work, so their number decides on the tasks, not their size
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / _TASK_ROWS))
    found = dealt.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius), "a long, b long")
    return scratch.save(found.distinct(), "links")


def band_count(similarity: float, miss: float) -> int:
    """How many bands leave a pair at the similarity without a common key with at most the probability ``miss``."""
    met = similarity**_PER_BAND
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met))


def _factors(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _signatures(width: int, bands: int):
    """Per text: its fingerprint, the digest of its words and the keys of its bands."""
    factors, mix = _factors(bands * _PER_BAND), _factors(_PER_BAND, 12)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, digests, keys = [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = _words(text.as_py())
                total, n, least = np.zeros(64, np.int64), 0, np.full(len(factors), 2**64 - 1, np.uint64)
                for hashes in _shingles(words, width):
                    total, n = total + _bit_counts(hashes), n + len(hashes)
                    for at in range(0, len(hashes), 512):  # stays in cache
                        np.minimum(least, (hashes[at : at + 512, None] * factors).min(axis=0), out=least)
                prints.append(int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True))
                digests.append(hashlib.md5(b" ".join(words)).digest())
                keys.append((least.reshape(bands, _PER_BAND) * mix).sum(axis=1, dtype=np.uint64).view(np.int64))
            added = [pa.array(prints, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "fp", "digest", "bands"])

    return rows


def with_signatures(docs: DataFrame, columns: list[tuple[Column, str]], text: Column, width: int, bands: int) -> DataFrame:
    """The named columns with ``fp``, ``digest`` and ``bands``."""
    rows = docs.select(*[c.alias(n) for c, n in columns], text.alias("_text"))
    added = [T.StructField("fp", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(_signatures(width, bands), T.StructType([*rows.schema.fields[:-1], *added]))


def _proposals(first: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` of nodes that share a band's key: a star for each key, from leaves to head, so few to a leaf."""
    rows = first.select("node", F.posexplode("bands").alias("kind", "value"))
    # bands take their heads by two orders, so that one group is not tied to one head
    order = F.xxhash64("node", F.pmod("kind", F.lit(2)))
    heads = rows.groupBy(F.col("kind").alias("k"), F.col("value").alias("v")).agg(F.min_by("node", order).alias("head"), F.count(F.lit(1)).alias("n"))
    met = rows.join(heads.where("n > 1").hint("merge"), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v"))).where("node <> head")
    return scratch.save(met.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "proposals")


def _shingle_sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (_words(text.as_py()) for text in batch.column(1))
            found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(words, width)])).view(np.int64) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "grams"])

    return sets


def _sets(edges: DataFrame, rows: DataFrame, text: str, scratch: Scratch, width: int) -> DataFrame:
    """``(node, grams)`` of the nodes that have an edge: only their texts are looked up, and they move once."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    # a merge join at every size: a side that grows with the corpus is never broadcast
    texts = rows.join(nodes.hint("merge"), F.col("uid") == F.col("node")).select("node", F.col(text).alias("text"))
    return scratch.save(texts.mapInArrow(_shingle_sets(width), "node long, grams array<long>"), "sets")


def _checked(edges: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Those edges whose texts have shingle sets of at least the Jaccard similarity."""
    left, right = sets.toDF("l", "l_grams"), sets.toDF("r", "r_grams")
    both = edges.join(left.hint("merge"), F.col("a") == F.col("l")).join(right.hint("merge"), F.col("b") == F.col("r"))
    shared = F.size(F.array_intersect("l_grams", "r_grams"))
    held = scratch.save(both.where(shared >= similarity * (F.size("l_grams") + F.size("r_grams") - shared)).select("a", "b"), "checked")
    scratch.release()
    return held


def _joins(grams: list[np.ndarray], side: np.ndarray, piece: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets of at least the similarity that join the pieces as all such pairs do; sides 0 and 1 only meet each other."""
    parent = {x: x for x in piece}

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]  # halves the path
        return x

    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, gram = np.unique(np.concatenate(grams), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    holders, counts = owner[order], np.bincount(gram)
    starts = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    joined = []
    for i in range(len(grams)):
        if side[i] == 0:
            continue
        mine = gram[ends[i] - sizes[i] : ends[i]]
        mine = mine[counts[mine] > 1]
        n = counts[mine]
        at = np.arange(n.sum()) + np.repeat(starts[mine] - (np.cumsum(n) - n), n)
        shared = np.bincount(holders[at], minlength=len(grams))
        close = (shared >= similarity * (sizes + sizes[i] - shared)) & ((side == 0) if side[i] == 1 else (np.arange(len(grams)) < i))
        for j in np.flatnonzero(close).tolist():
            a, b = root(piece[i]), root(piece[j])
            if a != b:
                parent[a] = b
                joined.append((j, i))
    return joined


def _cell_joins(similarity: float):
    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            piece = cell.column("piece").to_pylist()
            if len(set(piece)) < 2:
                continue
            grams = [g.values.to_numpy().view(np.uint64) for g in cell.column("grams")]
            found = _joins(grams, cell.column("side").to_numpy(), piece, similarity)
            nodes = cell.column("node").to_numpy()
            pairs = np.sort(nodes[np.array(found, dtype=np.int64).reshape(-1, 2)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return joins


def _completed(edges: DataFrame, held: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, shard_rows: int) -> DataFrame:
    """Links that join what ``held`` joins, and what it leaves apart inside the families that ``edges`` connect."""
    families = components(chained(edges), scratch).withColumnRenamed("component", "family")
    pieces = scratch.save(components(chained(held), scratch).toDF("member", "piece"), "pieces")
    members = families.join(pieces.hint("merge"), F.col("node") == F.col("member"), "left").select("node", "family", F.coalesce("piece", "node").alias("piece"))
    members = scratch.save(members, "members")
    torn = members.groupBy(F.col("family").alias("f")).agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    todo = meet(members, torn.select("f", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), [("family", "f")], "node")
    todo = todo.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    todo = todo.join(sets.withColumnRenamed("node", "owner").hint("merge"), F.col("node") == F.col("owner"))
    met = todo.select("family", "piece", "node", "grams", F.explode(_spread()).alias("c"))
    met = met.select(F.concat_ws("/", "family", "c.p", "c.q").alias("cell"), F.col("c.side").alias("side"), "piece", "node", "grams")
    found = met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_joins(similarity), "a long, b long")
    links = scratch.save(pieces.where("member <> piece").toDF("a", "b").union(found).distinct(), "links")
    scratch.drop(members, held, pieces)
    scratch.release()
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shard_rows: int = 512, carry: bool = False, shingle: int = SHINGLE,
    similarity: float | None = None, miss: float = 1e-4,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, one row per document.

    ``carry`` keeps the other columns too, and adds ``keeper``: true for one document of each component.
    ``similarity`` replaces the radius by an exact check of shingle sets, see above; it needs ``carry``.  ``miss`` is the
    probability that a pair exactly at the similarity is not proposed.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    added = ("fingerprint", "component_id", "keeper")
    kept = [c for c in docs.columns if c not in added or c in (id_col, text_col)] if carry else [id_col]
    inner = {c: f"d{i}" for i, c in enumerate(kept)}
    at = inner[id_col]
    columns = [(F.col(f"`{c}`"), a) for c, a in inner.items()]
    if similarity is None:
        rows = with_fingerprints(docs, columns, F.col(f"`{text_col}`"), shingle)
    else:
        rows = with_signatures(docs, columns, F.col(f"`{text_col}`"), shingle, band_count(similarity, miss))
    rows = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()), "prints")
    # every group of equal fingerprints, or of equal words where similarity counts, is one vertex; its name is its smallest id
    key = "fp" if similarity is None else "digest"
    head = F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), "uid")
    if similarity is None:
        first = scratch.save(rows.groupBy(key).agg(F.min(head).alias("first")).withColumn("node", F.col("fp")), "first")
        links = link_fingerprints(first.select("fp"), scratch, radius, shard_rows)
    else:
        first = rows.groupBy(key).agg(F.min(head).alias("first"), F.min_by("bands", head).alias("bands"))
        first = scratch.save(first.withColumn("node", F.col("first.uid")), "first")
        edges = _proposals(first, scratch)
        scratch.release()
        sets = _sets(edges, rows, inner[text_col], scratch, shingle)
        held = _checked(edges, sets, scratch, similarity)
        links = _completed(edges, held, sets, scratch, similarity, shard_rows)
        scratch.drop(edges, sets)
    groups = components(links, scratch).withColumnRenamed("node", "member")
    named = first.join(groups, F.col("node") == F.col("member"), "left").select(key, "first", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("head"))
    whole = named.join(heads, F.col("component") == F.col("c")).select(
        F.col(key).alias("key2"), F.col("head.id").alias("component_id"), F.col("head.uid").alias("head_uid")
    )
    whole = scratch.save(whole, "named")
    scratch.drop(first, links)
    # with texts on one side a merge join at every size, without them as Spark sees fit
    out = rows.join(whole.hint("merge") if carry else whole, F.col(key) == F.col("key2")).withColumn("keeper", F.col("uid") == F.col("head_uid"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select(*[F.col(a).alias(c) for c, a in inner.items()], hexed, "component_id", *(["keeper"] if carry else []))
