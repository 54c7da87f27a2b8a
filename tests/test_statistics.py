import math
import random

from pyspark.sql import functions as F

from gatehouse.operators import models
from gatehouse.operators import statistics as st


def test_hand_computed_constants(spark):
    xy = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "x double, y double")
    assert math.isclose(st.spearman(xy, "x", "y").first().r, 0.9486832980505138)
    mw = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "s double, y int")
    assert math.isclose(st.mann_whitney(mw, "s", "y").first().auroc, 0.875)
    p = spark.createDataFrame([(0, 0.005), (1, 0.04), (2, 0.5)], "k int, p double")
    assert [round(r.q, 9) for r in st.benjamini_hochberg(p, "p", "k").orderBy("k").collect()] == [0.015, 0.06, 0.5]
    ap = spark.createDataFrame([(0, 0.9, 1), (1, 0.8, 0), (2, 0.7, 1)], "k int, s double, y int")
    assert math.isclose(st.average_precision(ap, "s", "y", "k").first().ap, (1 + 2 / 3) / 2)
    c = spark.createDataFrame([(i, 5.0) for i in range(9)], "k int, v double")
    assert tuple(st.bootstrap_mean(c, "v", "k", resamples=50).first()) == (5.0, 5.0)


def test_refusals_and_missing_values(spark):
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0)], "x double, y double")
    assert st.pearson(two, "x", "y").first().degenerate == "n<3"
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert tuple(st.pearson(flat, "x", "y").first()) == (5, None, "zero variance")
    one_side = spark.createDataFrame([(1.0, 1)], "s double, y int")
    assert st.mann_whitney(one_side, "s", "y").first().auroc is None


def test_ranks_and_bins_against_plain_version(spark):
    rng = random.Random(0)
    values = [float(rng.randrange(40)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    order = sorted(values)
    want = {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}
    assert all(r["rank"] == want[r.v] for r in st.rank_avg(df, "v").collect())
    binned = {r.k: r.bin for r in st.equal_bins(df, "v", ["k"], 7).collect()}
    placed = sorted(range(500), key=lambda k: (values[k], k))
    edges = [b * 500 // 7 for b in range(8)]
    for i, k in enumerate(placed):
        assert edges[binned[k]] <= i < edges[binned[k] + 1]


def test_ridge_equals_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(80), rng.standard_normal((80, 3))])
    y = x @ [1, 2, 3, 4] + rng.standard_normal(80)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    m = models.Ridge.fit(df, "x", "y", lam=0.5)
    a = x.T @ x + 0.5 * np.eye(4)
    assert np.allclose(m.weights, np.linalg.solve(a, x.T @ y), atol=1e-9)
    got = df.select("x", m.predict(F.col("x")).alias("p"), m.variance(F.col("x")).alias("v")).first()
    assert math.isclose(got.p, float(np.dot(got.x, m.weights)), rel_tol=1e-9)
    assert math.isclose(got.v, float(np.array(got.x) @ np.linalg.inv(a) @ np.array(got.x)), rel_tol=1e-9)
