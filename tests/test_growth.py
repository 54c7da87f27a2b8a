"""Steps whose cost must not outgrow the table, and searches without a cap, against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gatehouse.functions import sequences as S
from gatehouse.operators import leakage, screens
from gatehouse.operators import statistics as st
from gatehouse.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_no_window_frame_reaches_to_the_end_of_its_range(spark):
    """Spark computes such a frame anew for every row: 60,000 rows in one range are 1.8 billion steps."""
    p = spark.range(50).select("id", (F.pmod(F.col("id") * 7, F.lit(50)) / 100).alias("p"))
    got = st.benjamini_hochberg(p, "p", "id")
    assert "currentrow$(), unboundedfollowing$()" not in plan(got)
    values = sorted((r.id * 7 % 50 / 100, r.id) for r in p.collect())
    raw = [v * 50 / (i + 1) for i, (v, _) in enumerate(values)]
    want = {key: min(1.0, *raw[i:]) for i, (_, key) in enumerate(values)}
    assert {r.id: round(r.q, 12) for r in got.collect()} == {k: round(v, 12) for k, v in want.items()}


def test_sketched_medians_and_bins_equal_the_full_order(spark, monkeypatch):
    """Bounds from a sketch change no result: heavy ties, several groups, a null group, missing values."""
    rows = [(None if i % 3 == 0 else f"g{i % 3}", None if i % 41 == 0 else float(i * 37 % 211) ** 2, i) for i in range(2500)]
    rows += [("g1", 7.0, 2500 + i) for i in range(600)]
    d = spark.createDataFrame(rows, "g string, v double, k int")
    clean = d.where("v is not null")
    read = lambda: (sorted(map(tuple, st.median(d, "v", ["g"]).collect()), key=str), st.median(d, "v").first().med, {r.k: r.bin for r in st.equal_bins(clean, "v", ["k"], 30).collect()})
    whole = read()
    monkeypatch.setattr(st, "RANGE_ROWS", 100)
    asked = []
    monkeypatch.setattr(st, "_zones", lambda *a, f=st._zones: asked.append(f(*a)) or asked[-1])
    assert read() == whole and asked[0] is not None
    monkeypatch.setattr(st, "MARGIN", 1e-9)  # bounds that miss: everything is ordered
    assert read() == whole


def test_wide_counts_give_the_statistics_of_long_ones_without_a_shuffle_by_guide(spark):
    rows = [(f"q{i}", i % 9, s, a, (i * f) % 97 + (s != "i2") * (i % 11 > 0)) for i in range(200) for s, a, f in (("i1", "initial", 5), ("i2", "initial", 3), ("f1", "final", 7))]
    long = spark.createDataFrame(rows, "guide string, gene int, sample string, arm string, n long")
    wide = long.groupBy("guide", "gene").agg(F.collect_list(F.struct("sample", "arm", "n")).alias("cells"))
    key = lambda d: {r.guide: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in d.select("guide", "gene", "init", "fin", "lfc", "depletion").collect()}
    assert key(screens.guide_stats(wide)) == key(screens.guide_stats(long))
    thin = lambda c: key(screens.guide_stats(screens.thin(c, 9.0)))
    assert thin(wide) == thin(long)
    assert "exchange hashpartitioning(guide" not in plan(screens.guide_stats(st.held(wide)))


def test_kmer_search_leaves_no_frequent_kmer_and_no_candidate_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(12)]
    train = [(i, "shared passage " + " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(150)] + [(150, ""), (151, None), (152, "shar")]
    asked = [(i, "shared passage " + " ".join(rng.choices(words, k=4))) for i in range(9)] + [(9, "shared passage"), (10, "zzzzzzzz"), (11, "shar")]
    grams = lambda x, k=5: {x[i : i + k] for i in range(len(x) - k + 1)} if len(x) >= k else {x} - {""}
    want = []
    for q, a in asked:
        near = sorted((-len(grams(a) & grams(b)) / len(grams(a) | grams(b)), t, len(grams(a) & grams(b))) for t, b in train if b and grams(a) & grams(b))
        want += [(q, i + 1, t, n, round(-s, 9)) for i, (s, t, n) in enumerate(near[:3])]
    frame = lambda rows: spark.createDataFrame(rows, "key long, text string")
    for block in (2000, 5):
        got = leakage.kmer_search(frame(asked), frame(train), "key", "text", 5, 3, block).collect()
        assert sorted((r.query, r.rank, r.neighbour, r.shared, round(r.similarity, 9)) for r in got) == sorted(want)


def test_base_counts_are_of_whole_texts_and_make_twenty_rows_at_most(spark, tmp_path):
    texts = [(0, "Añ b-c,D e\U0001f600f"), (1, "a"), (2, ""), (3, None), (4, "zz"), (5, "x" * 5000), (6, "ab"), (6, "ba")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lang": F.lit("l"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    base = dict(zip(S.LETTERS, S.BASES, strict=True))
    counts = Counter()
    for key, text in texts:
        dna = "".join(base.get(c, "") for c in text or "")
        counts.update((key, dna[i : i + k]) for k in (1, 2) for i in range(len(dna) - k + 1) if len(dna) > 1)
    total = Counter()
    for (key, kmer), n in counts.items():
        total[key, len(kmer)] += n
    got = catalog.queries()["kmer_freqs"](spark, str(tmp_path))
    assert {(r.doc_id, r.kmer): r.freq for r in got.collect()} == {(d, w): round(n / total[d, len(w)], 6) for (d, w), n in counts.items()}
    assert spark.createDataFrame(texts, "k long, t string").select(F.explode(S.base_counts("t"))).count() == 20 * 5
