"""The closed loop: construct, gate, acquire, measure, qualify, update, with a record of every cycle.

Designs are rows ``design, features, truth`` (null truth: cannot be measured) and whatever the design rules read.  A
cycle is a few jobs over DataFrames; what crosses to the driver is a model of p² numbers and one record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.operators.gates import readout_rules
from gatehouse.operators.leakage import hash_order
from gatehouse.operators.models import Ridge, acquisition
from gatehouse.operators.rules import RuleSet

# A readout's replicate CV and signal unless stress changes them, and what stress sets.
CV, SIGNAL, HIGH_CV, SATURATED = 0.05, 1.0, 0.40, 15.0


@dataclass(frozen=True)
class LoopConfig:
    seeds: int = 20
    cycles: int = 3
    propose: int = 60
    batch: int = 15
    lam: float = 1.0
    beta: float = 1.0
    strategy: str = "ucb"
    top_share: float = 0.1


def draw(tag: str, seed: int, key: Column) -> Column:
    """A uniform number in [0, 1) that depends on tag, seed and key alone: the head of their SHA-256."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{tag}|{seed}|"), key.cast("string")), 256), 1, 13)
    return F.conv(head, 16, 10).cast("double") / float(1 << 52)


def measure(designs: DataFrame) -> DataFrame:
    """Readouts of ordered designs: ``built, value, replicate_cv, signal, controls_ok``."""
    built = F.col("truth").isNotNull()
    return designs.withColumns({"built": built, "value": F.col("truth").cast("double"), "replicate_cv": F.lit(CV), "signal": F.lit(SIGNAL), "controls_ok": F.lit(True)})


def saturation(readouts: DataFrame, mean: float, limit: float, rate: float = 0.30, caught: float = 0.75, false_flags: float = 0.05, seed: int = 0) -> DataFrame:
    """Stress: strong designs read weak (flipped about the pool's mean) at a rate, a share of them visibly saturated.

    Weak designs are flagged falsely at ``false_flags`` and keep their value.
    """
    strong = F.col("value") >= limit
    hit = strong & (draw("sat", seed, F.col("design")) < rate)
    seen = hit & (draw("det", seed, F.col("design")) < caught)
    wrong = F.col("value").isNotNull() & ~strong & (draw("ff", seed, F.col("design")) < false_flags)
    return readouts.withColumns({
        "replicate_cv": F.when(wrong, HIGH_CV).otherwise(F.col("replicate_cv")), "signal": F.when(seen, SATURATED).otherwise(F.col("signal")),
        "value": F.when(hit, 2 * F.lit(mean) - F.col("value")).otherwise(F.col("value")),
    })


def run(pool: DataFrame, cfg: LoopConfig, design_rules: RuleSet | None = None, stress: Callable[[DataFrame], DataFrame] | None = None, seed: str = "loop", qualify: bool = True) -> DataFrame:
    """One row per cycle: ``cycle, proposed, rejected, chosen, flagged, qualified, measured, recall``.

    Without design rules, with ``qualify`` off and without stress this is the plain loop.  Picks that cannot be measured are
    counted, never replaced; a cycle in which no proposal passes is recorded and the loop goes on.
    """
    spark = pool.sparkSession
    truth = pool.where(F.col("truth").isNotNull())
    k = max(1, int(truth.count() * cfg.top_share))
    top = truth.orderBy(F.desc("truth"), "design").limit(k).select("design")
    first = truth.orderBy(hash_order(F.col("design"), seed), "design").limit(cfg.seeds)
    known = [(r["design"], float(r["truth"])) for r in first.select("design", "truth").collect()]  # seeds and batches: what was measured
    kind = pool.schema["design"].dataType.simpleString()
    records = []

    def measured_frame() -> DataFrame:
        return spark.createDataFrame(known, f"m_design {kind}, label double")

    for cycle in range(1, cfg.cycles + 1):
        seen = measured_frame()
        model = Ridge.fit(pool.join(F.broadcast(seen), F.col("design") == F.col("m_design")), "features", "label", cfg.lam)
        rest = pool.join(F.broadcast(seen), F.col("design") == F.col("m_design"), "left_anti")
        ranked = rest.withColumn("_mean", model.predict(F.col("features"))).orderBy(F.desc("_mean"), "design").limit(cfg.propose)
        verdicts = (design_rules or RuleSet("none")).evaluate(ranked)
        passing = verdicts.where("ok").withColumn("_score", acquisition(F.col("_mean"), model.variance(F.col("features")), cfg.strategy, cfg.beta))
        chosen = passing.orderBy(F.desc("_score"), "design").limit(cfg.batch).select("design", "truth")
        readouts = measure(chosen)
        readouts = stress(readouts) if stress else readouts
        read = readout_rules().evaluate(readouts) if qualify else readouts.withColumn("ok", F.lit(True))
        rows = read.select("design", "value", (F.col("ok") & F.col("value").isNotNull()).alias("good")).collect()  # one batch
        good = [(r["design"], r["value"]) for r in rows if r["good"]]
        counts = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
        known += good
        hits = measured_frame().join(top, F.col("m_design") == F.col("design"), "left_semi").count()
        records.append((cycle, counts["n"], counts["bad"], len(rows), len(rows) - len(good), len(good), len(known), hits / k))
        if not counts["n"]:
            break
    return spark.createDataFrame(records, "cycle int, proposed long, rejected long, chosen long, flagged long, qualified long, measured long, recall double")


def gap_slope(gated: DataFrame, plain: DataFrame, value: str = "recall") -> DataFrame:
    """``final_gap, slope`` of the difference by cycle over the cycles both have."""
    gaps = gated.select("cycle", F.col(value).alias("g")).join(plain.select("cycle", F.col(value).alias("p")), "cycle")
    gap = F.col("g") - F.col("p")
    return gaps.agg(F.max_by(gap, "cycle").alias("final_gap"), F.coalesce(F.regr_slope(gap, F.col("cycle")), F.lit(0.0)).alias("slope"))
