"""Repeated passages of at least ``width`` bytes, by a depth-limited radix sort of suffixes.

A byte goes if it lies in a ``width``-byte string that also starts somewhere else in the corpus.  Such a string is
a suffix cut at ``width`` bytes, and equal strings are exactly the groups that a most-significant-digit sort leaves
together after ``width`` bytes.  The passes read a digit at a time and drop every suffix that is alone:

1. Anchors.  In each window of ``width`` bytes the ``gram``-byte string with the smallest hash (the leftmost of
   equal ones) is the window's anchor.  Equal windows have equal anchors at equal offsets, so suffixes can be sorted
   by the anchor's digit first.  An anchor serves a run of neighbouring windows: one row stands for all of them.
   First pass: the anchor's gram.  Grams that occur once end here, with all their windows.
2. Second pass: the whole stretch of text that the anchor's windows cover.  Where two anchors agree in it, all
   their windows repeat; one of each such group goes on, for those that agree only in part.
3. Third pass, for grams with several different stretches: the windows of a stretch in blocks of ``step``
   neighbours.  The bytes common to a block's windows are the digit; blocks that are alone end here, and blocks
   that agree in all their bytes are equal groups.
4. Last pass: the remaining single windows, by all of their ``width`` bytes.  Groups of two or more are the repeats.

Digits are compared by hash: 64 bits in the passes that only discard, 128 bits where a group is declared equal.

Rows travel as one per anchor (about two per ``width`` bytes) in the first passes; whole texts are shuffled by
document key only to read the third and fourth digits and to cut the result.  No group is gathered: groups are
counted with map-side combine and joined back.

With ``passage_words`` set, the same passes over suffixes of words mark the texts that share a passage of more words
than that with another row, however few bytes it has; nothing more is removed.  Words are runs of bytes other than
ASCII white space, which itself does not count, and enter as 64-bit hashes.  A text is marked at the first passage
found, so there is no pass over blocks: texts of which no whole stretch repeats go on to the single windows, with all
other stretches of their grams.

Edge cases: a null text counts as empty and is returned as empty; texts under ``width`` bytes never lose a byte;
repeated rows repeat each other (both are cut, as strings are judged on the input, and both are marked); windows that
overlap count as starting elsewhere, but a passage that only repeats within its own text does not mark it; an empty table gives an empty result; extra columns pass through, except those named like a
result column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm._scratch import Scratch, row_key

_ADDED = ("kept", "n_bytes", "n_removed", "spans")
_FLUSH = 200_000
_CHUNK = 1 << 20  # windows of one text that are sorted out at a time; bytes of texts whose words are hashed at a time
_LONG = 64  # bytes of a word that is hashed by columns; longer ones are hashed one by one


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string, built by doubling from single bytes."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    have, size = (data.astype(np.uint64) + np.uint64(1)) * mix, 1
    parts: list[tuple[int, np.ndarray]] = []
    while size <= gram:
        if gram & size:
            parts.append((size, have))
        if 2 * size <= gram and len(have) > size:
            have = _blend(have[:-size], have[size:])
        size *= 2
    out, at = None, 0
    n = len(data) - gram + 1
    for size, values in parts:
        piece = values[at : at + n]
        out = piece.copy() if out is None else _blend(out, piece)
        at += size
    return out


def _blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return x


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` values, the place of its smallest one, the leftmost if equal."""
    n = len(values) - window + 1
    # keys order by value, then place, within blocks; two running minima meet in each window
    pad = -len(values) % window
    wide = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(wide, axis=1)
    place = np.arange(wide.size).reshape(wide.shape)
    fresh = np.ones(wide.shape, bool)
    fresh[:, 1:] = wide[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, place, -1), axis=1).ravel()
    turned = wide[:, ::-1]
    behind = np.minimum.accumulate(turned, axis=1)
    fresh = np.ones(wide.shape, bool)
    fresh[:, 1:] = turned[:, 1:] <= behind[:, :-1]
    back = np.where(fresh, place[:, ::-1], np.iinfo(np.int64).max)
    behind_at = np.minimum.accumulate(back, axis=1)[:, ::-1].ravel()
    left, right = behind_at[:n], ahead_at[window - 1 : window - 1 + n]
    return np.where(values[left] <= values[right], left, right)


def anchors(data: bytes, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(place, first window, last window, gram hash)`` of the anchors of a text, in parts of bounded size."""
    for start in range(0, len(data) - width + 1, _CHUNK):
        part = np.frombuffer(data, np.uint8)[start : start + _CHUNK + width - 1]
        hashes = gram_hashes(part, gram)
        at = window_minima(hashes, width - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        yield at[first] + start, first + start, last + start, hashes[at[first]].view(np.int64)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _anchor_rows(width: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                for place, first, last, digit in anchors(data, width, gram):
                    where = zip(place.tolist(), first.tolist(), last.tolist(), strict=True)
                    whole = [xxhash.xxh3_128_digest(data[a : b + width], seed=p - a) for p, a, b in where]
                    for column, values in zip(out, ([key] * len(place), place.tolist(), first.tolist(), last.tolist(), digit.tolist(), whole), strict=True):
                        column += values
                if len(out[0]) > _FLUSH:
                    yield _batch(dict(zip(_ANCHOR, zip(out, _ANCHOR.values(), strict=True), strict=True)))
                    out = [[] for _ in range(6)]
            yield _batch(dict(zip(_ANCHOR, zip(out, _ANCHOR.values(), strict=True), strict=True)))

    return rows


_ANCHOR = {"key": pa.binary(), "place": pa.int64(), "first": pa.int64(), "last": pa.int64(), "gram": pa.int64(), "stretch": pa.binary()}
_BLOCK = {"key": pa.binary(), "first": pa.int64(), "last": pa.int64(), "gram": pa.int64(), "digit": pa.int64(), "stretch": pa.binary()}
_WINDOW = {"key": pa.binary(), "first": pa.int64(), "digit": pa.binary()}


def _digit_rows(width: int, names: dict[str, pa.DataType], read):
    """Rows that ``read(data, one)`` gives for each suffix run ``one`` of ``todo``, in batches of bounded size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for one in todo:
                    out += [(key, *row) for row in read(data, one)]
                    if len(out) > _FLUSH:
                        yield _batch(dict(zip(names, zip(zip(*out, strict=True), names.values(), strict=True), strict=True)))
                        out = []
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield _batch(dict(zip(names, zip(columns, names.values(), strict=True), strict=True)))

    return rows


def _blocks(width: int, step: int):
    """Third digit: what all windows of a block have in common; and all that they cover."""

    def read(data: bytes, one: dict) -> Iterator[tuple]:
        # blocks are counted from the anchor, so equal windows fall into equal blocks
        near, far = one["place"] - one["last"], one["place"] - one["first"]
        for block in range(near // step, far // step + 1):
            low = one["place"] - min(far, block * step + step - 1)
            high = one["place"] - max(near, block * step)
            begin = one["place"] - block * step
            core = data[begin : max(begin, begin - step + 1 + width)]
            whole = xxhash.xxh3_128_digest(data[low : high + width], seed=one["place"] - low)
            yield low, high, one["gram"], xxhash.xxh3_64_intdigest(core, seed=block) - (1 << 63), whole

    return read


def _windows(width: int):
    """Last digit: all bytes of single windows."""

    def read(data: bytes, one: dict) -> Iterator[tuple]:
        for at in range(one["first"], one["last"] + 1):
            yield at, xxhash.xxh3_128_digest(data[at : at + width])

    return read


@cache
def _powers(n: int) -> tuple[np.ndarray, ...]:
    """A number for each byte value, the first ``n`` powers of an odd number and those of its inverse."""
    base = 0x9E3779B97F4A7C15
    table = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
    rows = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for row in rows:
        row[0] = 1
    return table, *(np.multiply.accumulate(row) for row in rows)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that lie end to end in ``data``, cut at ``edges``: where each starts, and a 64-bit hash of it."""
    filled = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    starts = np.flatnonzero(filled[1:] & (edge | ~filled[:-1]))
    ends = np.flatnonzero(filled[:-1] & (edge | ~filled[1:]))
    table, powers, inverses = _powers(_CHUNK + _LONG)
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _CHUNK, _CHUNK))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            begin = starts[a:b] - starts[a]
            end = np.minimum(ends[a:b] - starts[a], begin + _LONG)
            sums = np.zeros(end[-1] + 1, np.uint64)
            np.cumsum(table[data[starts[a] : starts[a] + end[-1]]] * powers[: end[-1]], out=sums[1:])
            out[a:b] = (sums[end] - sums[begin]) * inverses[begin]
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return starts, out ^ (out >> np.uint64(32))


def _word_anchors(texts: pa.Array, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(hashes, row, place, first window, last window, gram hash)`` of the anchors of many texts, in parts of bounded size."""
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
        edges = offsets[a : b + 1] - offsets[a]
        if edges[-1]:
            starts, hashes = word_hashes(np.frombuffer(values, np.uint8)[offsets[a] : offsets[b]], edges)
            row = np.searchsorted(edges, starts, "right") - 1 + a
            for start in range(0, len(hashes) - words + 1, _CHUNK):
                part, own = (x[start : start + _CHUNK + words - 1] for x in (hashes, row))
                grams = gram_hashes(part, gram)
                at = window_minima(grams, words - gram + 1)
                within = own[: len(at)] == own[words - 1 :]
                turn = np.concatenate(([True], (at[1:] != at[:-1]) | ~within[1:] | ~within[:-1], [True]))
                first, last = np.flatnonzero(within & turn[:-1]), np.flatnonzero(within & turn[1:])
                yield part, own[first], at[first], first, last, grams[at[first]].view(np.int64)
        a = b


_STRETCH = {"key": pa.binary(), "gram": pa.int64(), "lead": pa.int32(), "digit": pa.binary()}


def _stretch_rows(words: int, gram: int):
    """First and second digit: each stretch of a text once; ``lead`` is 1 once for each of its grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seen, met = batch.column(0).to_pylist(), set(), set()
            for part, row, place, first, last, digit in _word_anchors(batch.column(1), words, gram):
                raw, out = part.tobytes(), [[] for _ in _STRETCH]
                for r, p, a, b, g in zip(*(x.tolist() for x in (row, place, first, last, digit)), strict=True):
                    whole = xxhash.xxh3_128_digest(raw[8 * a : 8 * (b + words)], seed=p - a)
                    if (r, whole) not in seen:
                        seen.add((r, whole))
                        for column, value in zip(out, (keys[r], g, int((r, g) not in met), whole), strict=True):
                            column.append(value)
                        met.add((r, g))
                if len(row):  # a text lies in one part, but for its windows beyond a chunk
                    seen, met = ({x for x in found if x[0] == row[-1]} for found in (seen, met))
                yield _batch(dict(zip(_STRETCH, zip(out, _STRETCH.values(), strict=True), strict=True)))

    return rows


def _passage_windows(words: int, gram: int):
    """Last digit: all words of single windows, each once for its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, todo, seen = batch.column(0).to_pylist(), np.unique(batch.column(2).flatten().to_numpy()), set()
            for part, row, _, first, last, digit in _word_anchors(batch.column(1), words, gram):
                raw, out, wanted = part.tobytes(), ([], []), np.isin(digit, todo)
                for r, a, b in zip(*(x[wanted].tolist() for x in (row, first, last)), strict=True):
                    for at in range(a, b + 1):
                        whole = xxhash.xxh3_128_digest(raw[8 * at : 8 * (at + words)])
                        if (r, whole) not in seen:
                            seen.add((r, whole))
                            out[0].append(keys[r])
                            out[1].append(whole)
                if len(row):
                    seen = {x for x in seen if x[0] == row[-1]}
                yield _batch({"key": (out[0], pa.binary()), "digit": (out[1], pa.binary())})

    return rows


def _share_passages(texts: DataFrame, words: int, gram: int, scratch: Scratch) -> DataFrame:
    """Keys of the ``texts`` that hold a run of ``words`` words which another one holds too."""
    found = scratch.save(texts.mapInArrow(_stretch_rows(words, gram), "key binary, gram long, lead int, digit binary"), "word-anchors")
    # what is counted is written before it is joined: a join with a table can split a hot group, one on top of the count cannot
    shared = scratch.save(found.groupBy(F.col("gram").alias("g")).agg(F.sum("lead").alias("n")).where("n > 1").select("g"), "word-grams")
    left = scratch.save(found.join(shared, F.col("gram") == F.col("g")).select("key", "gram", "digit"), "word-stretches")
    scratch.drop(found, shared)
    scratch.release()
    whole = scratch.save(left.groupBy(F.col("gram").alias("g"), F.col("digit").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "word-kinds")
    hit = left.join(whole, (F.col("gram") == F.col("g")) & (F.col("digit") == F.col("d")))
    marked = scratch.save(hit.select(F.col("key").alias("k")).distinct(), "word-whole")
    # the other texts, and all that has their grams
    open_ = scratch.save(left.join(marked, F.col("key") == F.col("k"), "left_anti").select(F.col("gram").alias("g")).distinct(), "word-open")
    todo = left.join(open_, F.col("gram") == F.col("g")).select("key", F.col("gram").alias("run"))
    windows = _read_digits(texts, todo, scratch, _passage_windows(words, gram), "key binary, digit binary", "word-windows")
    scratch.drop(left, whole, open_)
    equal = scratch.save(windows.groupBy(F.col("digit").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "word-equal")
    rest = windows.join(equal, F.col("digit") == F.col("d")).select(F.col("key").alias("k"))
    all_ = scratch.save(marked.union(rest).distinct(), "word-marked")
    scratch.drop(marked, windows, equal)
    scratch.release()
    return all_


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs ``[start, end)`` covered by the given ones."""
    order = np.argsort(starts, kind="stable")
    runs: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def remove_repeats(
    docs: DataFrame, width: int = 400, gram: int = 32, step: int = 64, id_col: str = "doc_id", text_col: str = "text",
    passage_words: int | None = None, passage_gram: int = 16,
) -> DataFrame:
    """``docs`` with ``kept`` (binary: what remains), ``n_bytes``, ``n_removed`` and ``spans`` (start, end).

    ``passage_words`` adds ``shared_passage`` (1 or 0): a run of more words than that also stands in another row.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    added = _ADDED if passage_words is None else (*_ADDED, "shared_passage")
    columns = [c for c in docs.columns if c not in added or c in (id_col, text_col)]
    inner = {c: f"d{i}" for i, c in enumerate(columns)}
    text = F.col(inner[text_col])
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()])
    rows = rows.withColumn("key", row_key(F.col(inner[id_col]), text))
    texts = rows.select("key", text.alias("text"))
    marked = None if passage_words is None else _share_passages(texts, passage_words + 1, passage_gram, scratch)

    found = scratch.save(texts.mapInArrow(_anchor_rows(width, gram), "key binary, place long, first long, last long, gram long, stretch binary"), "anchors")
    # first and second pass: how often each gram and each stretch occurs
    stretches = found.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place", "first", "last")).alias("one"))
    stretches = scratch.save(stretches, "stretches")
    whole = stretches.where("n > 1").select(F.col("gram").alias("g"), F.col("stretch").alias("s"))
    repeats = [
        scratch.save(
            found.join(whole, (F.col("gram") == F.col("g")) & (F.col("stretch") == F.col("s"))).select("key", "first", (F.col("last") + width).alias("end")), "whole"
        )
    ]
    scratch.drop(found)
    # third pass: one of each stretch, where a gram has several
    several = stretches.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    todo = stretches.join(several, F.col("gram") == F.col("g")).select("one.key", F.struct("gram", "one.place", "one.first", "one.last").alias("run"))
    blocks = _read_digits(texts, todo, scratch, _digit_rows(width, _BLOCK, _blocks(width, step)), "key binary, first long, last long, gram long, digit long, stretch binary", "blocks")
    scratch.drop(stretches)
    here = F.struct("key", "first", "last")
    kinds = scratch.save(blocks.groupBy("gram", "digit", "stretch").agg(F.min(here).alias("one"), F.max(here).alias("other")), "kinds")
    same = kinds.where("one <> other").select(F.col("gram").alias("g"), F.col("digit").alias("d"), F.col("stretch").alias("s"))
    hit = blocks.join(same, (F.col("gram") == F.col("g")) & (F.col("digit") == F.col("d")) & (F.col("stretch") == F.col("s")))
    repeats.append(scratch.save(hit.select("key", "first", (F.col("last") + width).alias("end")), "blocks"))
    scratch.drop(blocks)
    # last pass: one of each block, where a digit has several
    several = kinds.groupBy(F.col("gram").alias("g"), F.col("digit").alias("d")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    todo = kinds.join(several, (F.col("gram") == F.col("g")) & (F.col("digit") == F.col("d"))).select("one.key", F.struct("one.first", "one.last").alias("run"))
    windows = _read_digits(texts, todo, scratch, _digit_rows(width, _WINDOW, _windows(width)), "key binary, first long, digit binary", "windows")
    scratch.drop(kinds)
    here = F.struct("key", "first")
    equal = windows.groupBy(F.col("digit").alias("d")).agg(F.min(here).alias("one"), F.max(here).alias("other")).where("one <> other").select("d")
    hit = windows.join(equal, F.col("digit") == F.col("d"))
    repeats.append(scratch.save(hit.select("key", "first", (F.col("first") + width).alias("end")), "single"))
    scratch.drop(windows)

    runs = repeats[0].union(repeats[1]).union(repeats[2]).groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("first", "end")).alias("runs"))
    joined = rows.join(runs, F.col("key") == F.col("k"), "left").drop("k")
    if marked is not None:
        joined = joined.join(marked, F.col("key") == F.col("k"), "left").withColumn("shared_passage", F.col("k").isNotNull().cast("int"))
    joined = joined.select(*inner.values(), *added[len(_ADDED) :], "runs")
    at = columns.index(text_col)
    results = T._parse_datatype_string("kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>").fields
    schema = T.StructType([*joined.schema.fields[:-1], *results])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, runs in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                data = (value.as_py() or "").encode()
                spans = []
                if runs.is_valid:
                    flat = runs.values.flatten()
                    spans = merge_spans(*(c.to_numpy(zero_copy_only=False) for c in flat))
                edges = [0, *(x for s in spans for x in s), len(data)]
                out[0].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out[1].append(len(data))
                out[2].append(sum(b - a for a, b in spans))
                out[3].append([{"start": a, "end": b} for a, b in spans])
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    result = joined.mapInArrow(cut, schema)
    return result.select(*[F.col(a).alias(c) for c, a in inner.items()], *added)


def _read_digits(texts: DataFrame, todo: DataFrame, scratch: Scratch, rows, schema: str, name: str) -> DataFrame:
    """Texts meet their own runs by key; equal rows may meet them twice, which the callers' comparisons bear."""
    own = todo.groupBy(F.col("key").alias("k")).agg(F.collect_set("run").alias("todo"))
    own = scratch.save(own, f"{name}-todo")
    met = texts.join(own, F.col("key") == F.col("k")).select("key", "text", "todo")
    out = scratch.save(met.mapInArrow(rows, schema), name)
    scratch.drop(own)
    scratch.release()
    return out
