import hashlib
import random
import re
from collections import defaultdict

from gatehouse.llm import mixing


def plain(rows, weights=(5, 2, 1), cap=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, t))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    words = {s: sum(size(t) for _, t in by[s]) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, list(names)
    while open_:
        left = sum(words.values()) - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= cap * words[s]]
        if not full:
            target |= share
            break
        target |= {s: float(cap * words[s]) for s in full}
        open_ = [s for s in open_ if s not in full]
    return words, target, size


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", None, "c", "tiny", "é", "empty"]
    rows = []
    for i in range(n):
        s = rng.choices(sources, [60, 8, 8, 12, 2, 10, 3])[0]
        text = None if i % 50 == 0 else "" if s == "empty" else " ".join(["w"] * int(rng.paretovariate(1.2) * 5))
        rows.append((i, text, s))
    return rows


def test_targets_and_takes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, -1) for r in rows], "doc_id long, text string, source string, size int, plan_src int")
    words, target, size = plain(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert r.size == size(text[r.doc_id]) and r.taken == r.size * r.copies <= 3 * r.size
        assert r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in words:
        assert abs(taken[s] - target[s]) <= max(largest[s] / 2 + 1, 0.02 * target[s]), s
    assert sum(target.values()) == sum(words.values()) or abs(sum(target.values()) - sum(words.values())) < 1e-6


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(1)
    once = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    random.Random(3).shuffle(rows)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()}
    assert once == again


def test_ranks_are_pareto(spark):
    """The copies drawn beyond the whole ones are those with the smallest odds, the filling document aside."""
    rows = [(i, "w " * 10, "s") for i in range(200)] + [(1000 + i, "w " * 10, "t") for i in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    t = [r for r in got if r.source == "t"]
    digest = lambda i: hashlib.md5(f"mix-1|{i}|{hashlib.md5(b'w ' * 10).hexdigest()}".encode()).hexdigest()
    order = sorted(t, key=lambda r: int(digest(r.doc_id)[:13], 16))
    copies = [r.copies for r in order]
    assert copies == sorted(copies, reverse=True)
    assert abs(sum(r.taken for r in t) - t[0].target) <= 10


def test_weights_repeated_rows_and_empty_table(spark):
    rows = [(i, "a b c", "s", float(i % 3)) for i in range(60)] * 2 + [(99, None, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    cfg = mixing.MixConfig(weight_col="weight")
    assert mixing.mix_sources(docs.where("weight > 0"), cfg).count() == 81
    mixed = mixing.mix_sources(docs)
    assert mixing.repeat_rows(mixed, ["doc_id"]).count() == sum(r.copies for r in mixed.collect())
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_joins_that_are_not_broadcast_give_the_same(spark, monkeypatch):
    """Above its row limit a table of sources is joined as Spark sees fit."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    here = sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "size", "target", "taken").collect()))
    monkeypatch.setattr(mixing, "small", lambda df, max_rows=0: df.hint("merge"))
    assert sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "size", "target", "taken").collect())) == here


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "one two", "a"), (3, "three", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert got[1].size == 300_000 and all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in got.values())
