import hashlib
import random
import re
from collections import Counter

import numpy as np

from gatehouse.llm import queries, suffix_dedup


def plain(texts, width):
    """(removed bytes, spans, kept) per text."""
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in blobs for i in range(len(b) - width + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_window_minima_leftmost():
    rng = np.random.default_rng(2)
    for n, w, top in ((1, 1, 3), (50, 7, 4), (300, 33, 3), (100, 100, 5), (257, 64, 1000)):
        values = rng.integers(0, top, n).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + w])) for i in range(n - w + 1)]
        assert suffix_dedup.window_minima(values, w).tolist() == want


def test_gram_hashes_depend_on_the_gram_alone():
    data = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    for gram in (1, 5, 13, 32):
        h = suffix_dedup.gram_hashes(data, gram)
        assert len(h) == len(data) - gram + 1 and (h[:-8] == h[8:]).all()
        assert len(set(h.tolist())) == 8


def check(spark, texts, width, gram, step, parts=3):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(parts)
    got = suffix_dedup.remove_repeats(docs, width, gram, step)
    assert got.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    for i, (removed, spans, kept) in enumerate(plain(texts, width)):
        r = rows[i]
        assert (r.n_removed, len(r.spans), bytes(r.kept)) == (removed, spans, kept), i
        assert r.n_bytes == len((texts[i] or "").encode())


def test_against_all_windows(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = noise(120), noise(45)
    texts = [None, "", "a", "x" * 500, "xy" * 100, noise(30)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(80)
            parts += [noise(rng.randrange(60)), rng.choice([passage, other, passage[a : a + rng.randrange(60)], "zz" * rng.randrange(40)])]
        texts.append("".join(parts))
    texts += [texts[20], texts[21][5:], "Q" + texts[22] + "R"]
    for width, gram, step in ((40, 8, 7), (24, 5, 30)):
        check(spark, texts, width, gram, step)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 50)
    check(spark, texts, 40, 8, 7)


def test_equal_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(90))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 40, 8, 7).collect())
    assert got == [(1, 90, b""), (1, 90, b""), (2, 0, b"short")]
    assert suffix_dedup.remove_repeats(docs.limit(0), 40, 8, 7).collect() == []


def test_ids_that_continue_in_the_text_do_not_clash(spark):
    text = "".join(random.Random(3).choice("abcdef") for _ in range(500))
    rows = [("1", "a|" + text), ("1|a", text), ("2", text[:450]), (None, text[:30]), ("", text[:30])]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"1": (502, 500), "1|a": (500, 500), "2": (450, 450), None: (30, 0), "": (30, 0)}


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain([r.text for r in docs], 400)
    got = queries.op5_suffix_dedup(spark, sf)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs) and any(w[0] for w in want)
    for doc, (removed, spans, kept) in zip(docs, want, strict=True):
        r, n = rows[doc.doc_id], len((doc.text or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert r.n_kept == len(kept) and r.kept_text == kept.decode(errors="replace")


def sharing(texts, words):
    """Which texts hold a run of ``words`` words that another one holds too."""
    runs = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in (re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts)]
    rows = Counter(x for own in runs for x in own)
    return [int(any(rows[x] > 1 for x in own)) for own in runs]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    texts = [b" ab\tabc", b"", b"abc", b"c\x0bab " + b"y" * 90 + b" " + b"y" * 91, b"ab", "\u00a0é".encode()]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    for chunk in (suffix_dedup._CHUNK, 5):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
        starts, hashes = suffix_dedup.word_hashes(data, edges)
        assert [bytes(data[s : s + len(w)]) for s, w in zip(starts.tolist(), want, strict=True)] == want
        assert len(set(zip(want, hashes.tolist(), strict=True))) == len(set(want)) == len(set(hashes.tolist()))


def test_shared_passages_against_all_windows(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: [rng.choice("aé bb c. ddd e".split()) + rng.choice(["", "", "x", "y"]) for _ in range(n)]
    passage, other = noise(30), noise(12)
    texts = [None, "", "a", "x " * 200, "x x\tx\n" * 9, " ".join(noise(11))]
    for _ in range(60):
        parts = noise(rng.randrange(30))
        a = rng.randrange(20)
        parts += rng.choice([passage, other, passage[a : a + rng.randrange(14)], ["z", "zz"] * rng.randrange(9), 3 * noise(13), []]) + noise(rng.randrange(20))
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[20], texts[21].replace(" ", "\n"), "Q" + texts[22] + "R"]
    want = sharing(texts, 12)
    assert 20 < sum(want) < len(texts) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, gram in ((suffix_dedup._CHUNK, 4), (40, 4), (40, 12), (suffix_dedup._CHUNK, 1)):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
        got = suffix_dedup.remove_repeats(docs.repartition(3), 400, passage_words=11, passage_gram=gram)
        assert [r.shared_passage for r in got.orderBy("doc_id").collect()] == want
    assert suffix_dedup.remove_repeats(docs.limit(0), 400, passage_words=11).collect() == []


def test_query_marks_passages_of_over_50_words_below_400_bytes(spark, tmp_path):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short, within = noise(55), noise(50), noise(60)
    texts = [noise(40) + " " + long, long + " " + noise(90), short + " " + noise(70), noise(20) + " " + short, f"{within} b {within}", noise(200), noise(80), None]
    texts += [texts[6], long.replace(" ", "\n")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.shared_passage for r in rows] == sharing(texts, 51) == [1, 1, 0, 0, 0, 0, 1, 0, 1, 1]
    # the contract's columns go by 400 bytes alone
    assert [r.n_removed for r in rows] == [x[0] for x in plain(texts, 400)] and rows[0].n_removed == 0 < rows[6].n_removed


def test_equal_rows_share_their_passage(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[3:100])], "doc_id long, text string")
    assert sorted((r.doc_id, r.shared_passage) for r in suffix_dedup.remove_repeats(docs, passage_words=50).collect()) == [(1, 1), (1, 1), (2, 0)]
