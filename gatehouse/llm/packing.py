"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

A document is its token ids and an end id.  It is cut at multiples of the sequence length; the histogram of piece
lengths (at most ``length`` bins, whatever the corpus) goes to the driver.  Lengths are placed longest first, each
into the pack pattern with the most room left, or into new packs if it fits nowhere; a pattern stands for a number
of equal packs, so the work depends on the bins alone.  Every placement is an interval of ranks of its length, and
pieces find their sequence and offset by rank.

A piece's rank among those of its length is its local rank in its partition plus the pieces of that length in
earlier partitions, so no length is ever gathered in one task.  Those offsets are one map of at most ``length`` entries for
each partition; up to ``broadcast_parts`` of them (some 130 MB) are broadcast and the ids stay where they are, more are
merge-joined by partition and the ids move once.

Edge cases: a null text counts as empty, an empty text is the end id alone; very long texts become many pieces;
repeated rows are packed as often as they occur; an empty table gives an empty result; ``start`` and ``offset``
restart per document and per sequence; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm._scratch import Scratch
from gatehouse.llm.tokens import encoder

#: Tokens held before a batch of pieces is passed on.
_FLUSH = 4_000_000


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``{piece length: how many}`` -> ``[(number of packs, [(piece length, first rank), ...]), ...]``.

    Pack ``j`` of an entry holds, for each slot, the piece of that length with rank ``first rank + j``.
    """
    heap: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-room, order, packs, slots)
    order = 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            if heap and -heap[0][0] >= size:
                room, _, packs, slots = heapq.heappop(heap)
                use, room = min(left, packs), -room
                if use < packs:
                    order += 1
                    heapq.heappush(heap, (-room, order, packs - use, [(s, r + use) for s, r in slots]))
                order += 1
                # packs just filled stay eligible for the same size: the shortest pack comes first, whoever it is
                heapq.heappush(heap, (size - room, order, use, [*slots, (size, rank)]))
                rank, left = rank + use, left - use
                continue
            # nothing has room: new packs, each holding as many of this size as fit, then one with the remainder
            each = length // size
            for packs, fill in ((left // each, each), (1, left % each)):
                if packs and fill:
                    order += 1
                    heapq.heappush(heap, (size * fill - length, order, packs, [(size, rank + i * packs) for i in range(fill)]))
                    rank += packs * fill
            left = 0
    return [(packs, slots) for _, _, packs, slots in sorted(heap)]


def _placements(packs: list[tuple[int, list[tuple[int, int]]]], length: int) -> np.ndarray:
    """Rows ``(key, first sequence, offset)`` sorted by key, where key orders by (piece length, first rank)."""
    rows, first = [], 0
    for number, slots in packs:
        offset = 0
        for size, rank in slots:
            rows.append((size, rank, first, offset))
            offset += size
        first += number
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def tokenize(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(id, start, length, doc_tokens, ids, part, local)``; ``ids`` are little-endian unsigned 32-bit."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    types = {"start": T.LongType(), "length": T.LongType(), "doc_tokens": T.LongType(), "ids": T.BinaryType(), "part": T.LongType(), "local": T.LongType()}
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in types.items())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer), np.zeros(length + 1, np.int64)
        part = TaskContext.get().partitionId()
        id_type = None

        def flush(out: list[tuple]) -> pa.RecordBatch:
            at, start, size, total, data, local = zip(*out, strict=True) if out else ([], [], [], [], [], [])
            columns = [pa.array(at, id_type), *(pa.array(c, pa.int64()) for c in (start, size, total))]
            columns += [pa.array(data, pa.binary()), pa.array([part] * len(out), pa.int64()), pa.array(local, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["id", *types])

        for batch in batches:
            id_type, out, held = batch.schema.field(0).type, [], 0
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    out.append((at, start, len(piece), len(ids), piece.tobytes(), int(seen[len(piece)])))
                    seen[len(piece)] += 1
                held += len(ids)
                if held > _FLUSH:
                    yield flush(out)
                    out, held = [], 0
            yield flush(out)

    return rows.mapInArrow(pieces, schema)


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", broadcast_parts: int = 4096
) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, ids, sequence_id, offset``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(tokenize(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    cells = scratch.save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "cells")
    # at most `length` rows come to the driver
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(_placements(pack_histogram(counts, length), length))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = cells.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")).groupBy(F.col("part").alias("b_part"))
    bases = scratch.save(bases.agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases")), "bases")
    scratch.drop(cells)
    near = F.broadcast(bases) if bases.limit(broadcast_parts + 1).count() <= broadcast_parts else bases.hint("merge")
    ranked = pieces.join(near, F.col("part") == F.col("b_part"))
    ranked = ranked.select("id", "start", "length", "doc_tokens", "ids", (F.element_at("bases", F.col("length")) + F.col("local")).alias("rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = placed.value
        by_length = {int(s): table[table[:, 0] == s] for s in np.unique(table[:, 0])}
        for batch in batches:
            sizes, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                own, rows = by_length[int(size)], np.flatnonzero(sizes == size)
                hit = np.searchsorted(own[:, 1], ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = own[hit, 2] + ranks[rows] - own[hit, 1], own[hit, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(assign, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, length: int = 2048) -> DataFrame:
    """``sequence_id, ids array<long>, used``: the training sequences, pieces in offset order, not yet padded.

    A sequence holds at most ``length`` ids, so its group is bounded.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("used"))
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("used", T.LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), batch.column(2)], names=schema.names)

    return grouped.mapInArrow(join, schema)
