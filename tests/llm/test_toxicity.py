import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gatehouse.llm import queries, toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    syllables = ["la", "mi", "ro", "ten", "sha", "ver", "ing", "do", "pe", "qua"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [word() for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(["Fiend", "wretch", "grub" + word(), "grub" + word()])
        docs.append((i, " ".join(text), rng.random()))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    truth = {i: t for i, _, t in labels}
    odd = [(5000, None, 0.0), (5001, "", 0.0), (None, "fiend wretch", 0.0), (5002, "la mi " * 50_000, 0.0), (5003, "Wretch!", 0.0)]
    d = spark.createDataFrame(docs + odd + docs[:1], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels[:700], (0, 1, None), (1, 0, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    assert all(w in model.words or any(w.startswith(b) for b in model.beginnings) for w in ("fiend", "wretch", "grubla"))
    got = toxicity.score(d, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(docs) + len(odd) + 1
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0 or i >= 700]
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.98
    assert rows[5000].predicted == rows[5001].predicted == rows[5002].predicted == 0
    assert rows[5003].predicted == 1 and rows[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, x double")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def test_label_model_finds_classes_and_near_copies():
    rng = np.random.default_rng(0)
    y = rng.random(8000) < 0.2
    right, wrong = [0.6, 0.5, 0.4, 0.5, 0.6], [0.002, 0.004, 0.01, 0.001, 0.003]
    fires = np.column_stack([rng.random(8000) < np.where(y, r, w) for r, w in zip(right, wrong, strict=True)])
    copies = np.repeat(fires[:, 2:3], 6, axis=1) & (rng.random((8000, 6)) < 0.98)  # six near-copies of the weakest voter
    fires = np.column_stack([fires, copies, ~fires.any(axis=1)])
    side = np.append(np.ones(11, bool), False)
    p, accuracy, model = toxicity.label_model(fires, side, np.ones(8000), 0.2)
    assert np.mean((p > 0.5) == y) > 0.97
    assert accuracy.min() > 0.85 and abs(accuracy[11] - (~y)[fires[:, 11]].mean()) < 0.05
    # the copies hang on one another, and together they say hardly more than the one voter does
    family = {2, *range(5, 11)}
    assert sum(int(model.parent[j]) in family for j in family) >= 6
    alone, group = np.zeros((2, 12), bool)
    alone[0], group[list(family)] = True, True
    one, many = model.log_ratio(np.stack([alone, group]))
    apart = np.log(model.rate[1, 0] / model.rate[0, 0])[list(family)].sum()  # what it would be without dependencies
    assert many < 0.35 * apart and many < 3 * one


def test_best_cut_lies_in_the_middle_of_the_gap():
    assert toxicity.best_cut(np.array([3.0, 1.0, -1.0, -2.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 0.0
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([1, 1]), np.ones(2)) < 1.0


def test_repeated_ids_bring_one_text_each(spark):
    docs, labels = corpus(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    again = docs + [(docs[1][0], "~", 0.0)] * 50
    sample, _ = toxicity._sample(spark.createDataFrame(again, "doc_id long, text string, x double"), lab, toxicity.ToxicityConfig(), "doc_id", "text")
    assert sample.count() == sample.select("id").distinct().count()


def test_without_labels_or_rows(spark):
    docs, _ = corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string, x double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, none)
    assert {r.score for r in toxicity.score(d, model).collect()} == {0.0}
    assert toxicity.score(d.limit(0), model).collect() == []


def test_query_finds_toxic_documents_and_leaves_clean_ones(spark):
    """Of the toxic documents of these tables about one in twenty holds no word that any other toxic document has."""
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).cache()
    assert got.count() == 10_000 and got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {(r.held_out, r.toxic): r.share for r in got.join(labels, "doc_id").groupBy("held_out", "toxic").agg(F.avg("predicted").alias("share")).collect()}
    got.unpersist()
    assert seen[True, 1] >= 0.9 and seen[False, 1] >= 0.93  # recall
    assert seen[True, 0] <= 0.01 and seen[False, 0] <= 0.01  # false alarms


def test_query_on_few_labels(spark):
    sf = "/root/testdata/sf0.01"
    seen = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.toxic: r.share for r in seen.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()}
    assert share[1] >= 0.85 and share[0] <= 0.03
