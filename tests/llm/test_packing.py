import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gatehouse.llm import packing, queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_plain_library():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    alphabet = list("abcdeABC ,.'\n\t0123456789éßç東🙂  \x1c-|") + ["<|endoftext|>", " the", "  ", "'s"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))
        assert list(tokens.encoder(PATH)(text)) == plain.encode(text, add_special_tokens=False).ids, text
    for text in ("a" * 5000, " " * 5000, "ab " * 4000):
        assert list(tokens.encoder(PATH)(text)) == plain.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_plain_library_on_every_code_point():
    """Each code point below U+20000 alone, within a word, between spaces and beside a digit."""
    plain, fast = Tokenizer.from_file(PATH), tokens.encoder(PATH)
    points = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [t for c in points[at : at + 4096] for t in (c, f"a{c}b {c} 1{c}{c}.")]
        for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert list(fast(text)) == want.ids, text


def test_offsets_joined_instead_of_broadcast(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 90)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    here, there = ({tuple(r) for r in packing.pack(docs, PATH, length=64, broadcast_parts=n).drop("ids").collect()} for n in (4096, 0))
    spans = {(r[4], r[5], r[5] + r[2]) for r in there}
    assert len(here) == len(there) == len(spans)
    assert {(r[0], r[1], r[2], r[3]) for r in here} == {(r[0], r[1], r[2], r[3]) for r in there}
    for sequence in {s for s, _, _ in spans}:
        ends = sorted((a, b) for s, a, b in spans if s == sequence)
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:])) and ends[-1][1] <= 64


def test_histogram_packs_every_piece_once():
    rng = random.Random(5)
    for length in (16, 100, 2048):
        for spread in (3, 40, length):
            counts = Counter(rng.randint(1, min(length, spread)) for _ in range(rng.randrange(1, 3000)))
            packs = packing.pack_histogram(dict(counts), length)
            seen = defaultdict(set)
            for number, slots in packs:
                assert number > 0 and sum(s for s, _ in slots) <= length
                for size, rank in slots:
                    for r in range(rank, rank + number):
                        assert r not in seen[size]
                        seen[size].add(r)
            assert {s: len(v) for s, v in seen.items()} == dict(counts)
            assert all(max(v) == len(v) - 1 for v in seen.values())
            used = sum(s * n for s, n in counts.items())
            assert sum(n for n, _ in packs) <= 2 * used / length + 1


def test_round_trip(spark):
    rng = random.Random(11)
    words = [f"wort{i}" for i in range(50)] + ["naïve", "x"]
    texts = [None, "", "a"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400]))) for _ in range(60)]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(3, texts[3], 5), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    packed = packing.pack(docs, PATH, length=64)
    got = packed.collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    by_doc = defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) >= 0
        by_doc[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for (i, ids), n in want.items():
        for start in range(0, len(ids), 64):
            assert by_doc[i].count((start, len(ids), ids[start : start + 64])) == n
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for taken in slots.values():
        at = 0
        for offset, size in sorted(taken):
            assert offset == at
            at += size
        assert at <= 64
    assert sorted(slots) == list(range(len(slots)))
    whole = {r.sequence_id: r for r in packing.sequences(packed, 64).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(r.length for r in got)
    assert all(len(r.ids) == r.used for r in whole.values())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_against_the_plain_library(spark):
    sf = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_packing(spark, sf)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    covered, packs = defaultdict(int), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        packs[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for slots in packs.values():
        ends = [0]
        for offset, length in sorted(slots):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(packs) <= 1.05 * sum(covered.values()) / 2048 + 1
