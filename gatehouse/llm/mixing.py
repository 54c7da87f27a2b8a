"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Every source has a target number of words: its share of all words by weight, at most ``max_repeats`` times its
own words, the excess being shared out again by weight until no source is above its bound.  A source takes each
of its documents ``floor(target / words)`` whole times (the certain copies).  What is left, a fraction ``f`` of
the source, is drawn by Pareto order sampling: document ``i`` gets the rank
``[U_i / (1 - U_i)] / [p_i / (1 - p_i)]`` with ``U_i`` uniform and ``p_i`` its inclusion probability, and the
documents with the smallest ranks are taken until the words left are used up.  Without document weights
``p_i = f``; with weights the inclusion *odds* are ``w_i * f / (1 - f)``.  ``f`` is one number for a source, so it
does not change the order within it and the ranks need no second pass.  The sample ends before the first
document that would exceed what is left; then the one document outside the sample whose size comes closest to
the gap joins, if that brings the total nearer to the target.

``U`` comes from MD5 of seed, id and text, so reruns agree whatever the partitioning.

Plan: one scan makes slim rows ``(id, source, size, rank)`` in a scratch table; sums by (source, rank bucket)
with map-side combine find each source's crossing bucket; only that bucket is sorted.  The outcome is one row
per source with a cut-off rank, so documents are decided by a comparison and never shuffled.  The window over
sources holds one row per source.

Edge cases: a null or empty text, or one of white space only, has size 0 and is taken 0 times; a null source is
a source of its own, last in order; rows equal in id, source and text are one unit of the draw (taken together);
an empty table gives an empty result; other columns pass through untouched, except those named like a result
column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatehouse.llm._scratch import Scratch, bits, small

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 1024
_ADDED = ("size", "source_size", "target", "copies", "taken")


@dataclass(frozen=True)
class MixConfig:
    weights: Sequence[int] = (5, 2, 1)
    max_repeats: int = 3
    seed: str = "mix-1"
    weight_col: str | None = None


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rank(doc_id: Column, text: Column, cfg: MixConfig, weight: Column) -> tuple[Column, Column]:
    """Pareto rank without the source's constant, and the digest that breaks ties."""
    digest = F.md5(F.concat_ws("|", F.lit(cfg.seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    u = (bits(digest) + F.lit(0.5)) / F.lit(float(1 << 52))
    return (u / (F.lit(1.0) - u)) / weight, digest


def _targets(totals: DataFrame, cfg: MixConfig) -> DataFrame:
    """``src, words`` -> with ``w, target, whole, left``; water-filling in one ordered pass over sources."""
    by_name = W.orderBy(F.col("src").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)) for w in cfg.weights])
    ranked = totals.withColumn("w", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(cfg.weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("words") * cfg.max_repeats)
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    upto, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    x = (
        ranked.withColumn("total", F.sum("words").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("share", (F.col("total") - F.col("cap_before")) * F.col("w") / F.col("w_left"))
        .withColumn("capped", F.col("cap") <= F.col("share"))
    )
    # the first source below its bound fixes the level for itself and all after it
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), "src", "total", "cap_before", "w_left"))).over(every)
    x = x.withColumn("lv", level)
    free = F.col("lv").isNotNull() & ~F.col("capped")
    target = F.when(free, (F.col("lv.total") - F.col("lv.cap_before")) * F.col("w") / F.col("lv.w_left")).otherwise(F.col("cap").cast("double"))
    x = x.withColumn("target", F.least(target.cast("double"), F.col("cap").cast("double")))
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    return x.select("src", "words", "target", whole.alias("whole"), (F.col("target") - whole * F.col("words")).alias("left"))


def _within() -> Column:
    """Is the row in the drawn sample of its source, the filling document aside?"""
    rank, digest = F.col("rank"), F.col("digest")
    upto_cut = (rank < F.col("plan_cut.rank")) | ((rank == F.col("plan_cut.rank")) & (digest <= F.col("plan_cut.digest")))
    return F.coalesce((F.col("bucket") < F.col("plan_bucket")) | ((F.col("bucket") == F.col("plan_bucket")) & F.coalesce(upto_cut, F.lit(False))), F.lit(False))


def _plan(slim: DataFrame, scratch: Scratch, cfg: MixConfig) -> DataFrame:
    """One row per source: words, target, whole copies, crossing bucket, cut-off and the filling document's digest."""
    cells = scratch.save(slim.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "cells")
    targets = scratch.save(_targets(cells.groupBy("src").agg(F.sum("words").alias("words")), cfg), "targets")
    before = F.coalesce(F.sum("c.words").over(W.partitionBy("c.src").orderBy("c.bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cross = (
        cells.alias("c")
        .join(small(targets).alias("t"), F.col("c.src").eqNullSafe(F.col("t.src")))
        .select(F.col("c.src").alias("x_src"), F.col("c.bucket").alias("x_bucket"), F.col("c.words").alias("words"), before.alias("before"), "left")
        .where("left > 0 and before <= left and before + words > left")
        .select("x_src", "x_bucket", "before", "left")
    )
    cross = scratch.save(cross, "cross")
    units = (
        slim.where("size > 0")
        .join(small(cross), F.col("src").eqNullSafe(F.col("x_src")) & (F.col("bucket") == F.col("x_bucket")))
        .groupBy("src", "rank", "digest")
        .agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("left").alias("left"))
    )
    upto = F.col("before") + F.sum("size").over(W.partitionBy("src").orderBy("rank", "digest").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = (
        units.withColumn("upto", upto)
        .where("upto <= left")
        .groupBy(F.col("src").alias("c_src"))
        .agg(F.max(F.struct("rank", "digest")).alias("cut"), F.max("upto").alias("upto"))
    )
    state = (
        targets.join(cross.drop("left"), F.col("src").eqNullSafe(F.col("x_src")), "left")
        .join(cut, F.col("src").eqNullSafe(F.col("c_src")), "left")
        .select(
            F.col("src").alias("plan_src"), F.col("words").alias("plan_words"), F.col("target").alias("plan_target"),
            F.col("whole").alias("plan_whole"), F.col("x_bucket").alias("plan_bucket"), F.col("cut").alias("plan_cut"),
            (F.col("left") - F.coalesce("upto", "before", F.lit(0))).alias("plan_gap"),
        )
    )
    state = scratch.save(state, "state")
    off = F.abs(F.col("size") - F.col("plan_gap"))
    nearest = (
        slim.where("size > 0")
        .join(small(state), F.col("src").eqNullSafe(F.col("plan_src")))
        .where(F.col("plan_bucket").isNotNull() & ~_within() & (off < F.col("plan_gap")))
        .groupBy(F.col("src").alias("f_src"))
        .agg(F.min(F.struct(off.alias("off"), "rank", "digest")).alias("fill"), F.first("plan_gap").alias("gap"))
    )
    nearest = scratch.save(nearest, "nearest")
    # a unit of several equal rows joins whole, so its sum must be near the gap as well
    fill = (
        slim.join(small(nearest), F.col("src").eqNullSafe(F.col("f_src")) & (F.col("digest") == F.col("fill.digest")))
        .groupBy("f_src")
        .agg(F.sum("size").alias("unit"), F.first("gap").alias("gap"), F.first("fill.digest").alias("plan_fill"))
        .where("abs(unit - gap) < gap")
        .select("f_src", "plan_fill")
    )
    plan = scratch.save(state.join(fill, F.col("plan_src").eqNullSafe(F.col("f_src")), "left").drop("f_src"), "plan")
    scratch.drop(cells, targets, cross, state, nearest)
    return plan


def _slim(cfg: MixConfig, doc_id: Column, text: Column, source: Column, weight: Column | None) -> list[Column]:
    rank, digest = _rank(doc_id, text, cfg, F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0)))
    bucket = F.least(F.floor(rank / (F.lit(1.0) + rank) * _BUCKETS), F.lit(_BUCKETS - 1)).cast("int")
    return [source.alias("src"), word_count(text).alias("size"), rank.alias("rank"), digest.alias("digest"), bucket.alias("bucket")]


def mix_sources(
    docs: DataFrame, cfg: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words taken, repeats counted)."""
    cfg = cfg or MixConfig()
    scratch = Scratch(docs.sparkSession, "mix")
    kept = [c for c in docs.columns if c not in _ADDED or c in (id_col, text_col, source_col)]
    inner = {c: f"d{i}" for i, c in enumerate(kept)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(a) for c, a in inner.items()],
        *_slim(cfg, *(F.col(f"`{c}`") for c in (id_col, text_col, source_col)), F.col(f"`{cfg.weight_col}`") if cfg.weight_col else None),
    )
    slim = scratch.save(rows.select("src", "size", "rank", "digest", "bucket"), "slim")
    plan = _plan(slim, scratch, cfg)
    scratch.drop(slim)
    drawn = (F.col("size") > 0) & (_within() | F.coalesce(F.col("digest") == F.col("plan_fill"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("plan_whole") + drawn.cast("long")).otherwise(0).cast("long")
    return (
        rows.join(small(plan), F.col("src").eqNullSafe(F.col("plan_src")))
        .withColumn("copies", copies)
        .select(
            *[F.col(a).alias(c) for c, a in inner.items()], "size", F.col("plan_words").alias("source_size"),
            F.col("plan_target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixed corpus itself: ``columns`` of every document, once per copy it takes."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(*[f"`{c}`" for c in columns], again.alias("_copy")).drop("_copy")
