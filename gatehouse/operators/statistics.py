"""Rank statistics and multiple testing as plans whose global order is never taken in one task.

A global order is cut into ranges of some ``RANGE_ROWS`` rows.  Totals per range are few rows, so a value's running total
is the total of the ranges before it plus a window within its own range; where the cuts lie changes nothing in the result.
Medians and bins of equal count need the order at a few places only: a sketch bounds these, and what lies between the bounds
is ordered exactly.  Counts tell whether the bounds hold; where they do not, everything is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.sources.scratch import held, narrow

#: Rows of a range, and the most ranges there are.
RANGE_ROWS, MAX_RANGES = 200_000, 20_000
#: A sketch is asked that much (a share of the rows) beside a place; its own error is at most half of it.  Most bins that it serves.
MARGIN, MAX_SKETCHED = 2e-4, 100


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_range``, rising along the order: how many ranges follows from the rows, and ties may part."""
    df = held(df)
    ranges = min(MAX_RANGES, -(-df.count() // RANGE_ROWS))
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0))
    return held(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def running_total(df: DataFrame, order: str, value: str, by: Sequence[str] = (), ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows earlier in the order by (order, ties), per group.

    Rows equal in order and ties must not exist for a defined result.
    """
    line = [F.desc(order) if descending else F.asc(order), *(F.asc(t) for t in ties)]
    df = ranged(df, *line)
    sums = df.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    # one row for each group and range
    earlier = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_range").alias("_r"), earlier.alias("_base"))
    match = F.col("_range") == F.col("_r")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    own = W.partitionBy(*by, "_range").orderBy(*line).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(base, match).withColumn("before", F.col("_base") + F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.drop("_range", "_r", "_base", *[f"_b_{b}" for b in by])


def rank_avg(df: DataFrame, value: str, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of ``value`` where ties share their mean rank, and ``ties``, their number.

    Null values are dropped first.  Only distinct values are ordered.
    """
    df = held(narrow(df, df.where(F.col(value).isNotNull())))
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_total(counts, value, "ties", by)
    ranked = ranked.select(*[F.col(b).alias(f"_r_{b}") for b in by], F.col(value).alias("_value"), "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias(rank))
    match = F.col(value) == F.col("_value")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    return df.join(ranked, match).drop("_value", *[f"_r_{b}" for b in by])


def _refusal(n: Column, constant: Column) -> Column:
    return F.when(n < 3, F.lit("n<3")).when(constant, F.lit("zero variance"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group ``n, r`` and ``degenerate``: the reason why there is no r."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # equal least and greatest value: exact where a variance would leave rounding errors
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & ~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("r"), _refusal(n, constant).alias("degenerate"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson of average ranks, taken after rows with a missing side are dropped."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = rank_avg(df, "_x", by, "_rx").drop("ties")
    return pearson(rank_avg(ranked, "_y", by, "_ry"), "_rx", "_ry", by)


def tie_sum() -> Column:
    """Over the rows of ``rank_avg``: t³ - t summed over the tied values, t rows each."""
    t = F.col("ties").cast("double")
    return F.sum(t * t - 1)


def mann_whitney(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: ``n_pos, n_neg, u, auroc, z`` of ``score`` where ``positive`` is 1 against 0.

    Degenerate (null u, auroc and z) if a side is empty; z is 0 if all values tie.
    """
    ranked = rank_avg(df.where(F.col(positive).isNotNull()), score)
    is_pos = F.col(positive) == 1
    x = ranked.agg(
        F.count_if(is_pos).alias("n_pos"), F.count_if(~is_pos).alias("n_neg"), F.sum(F.when(is_pos, F.col("rank"))).alias("rank_sum"), tie_sum().alias("tie_sum")
    )
    a, b = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    both = (a > 0) & (b > 0)
    n = a + b
    u = F.col("rank_sum") - a * (a + 1) / 2
    spread = a * b / 12 * (n + 1 - F.col("tie_sum") / (n * (n - 1)))
    z = F.when(spread > 0, (u - a * b / 2) / F.sqrt(spread)).otherwise(0.0)
    return x.select("n_pos", "n_neg", F.when(both, u).alias("u"), F.when(both, u / (a * b)).alias("auroc"), F.when(both, z).alias("z"))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """``df`` with ``q``: the least of p·n/rank over this and all later ranks, at most 1; ties by ``key``."""
    df = held(df)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(narrow(df, df.withColumn("_one", F.lit(1))), p, "_one", ties=[key]).crossJoin(F.broadcast(n))  # one row
    ranked = ranged(ranked.withColumn("_raw", F.col(p) * F.col("_n") / (F.col("before") + 1)), F.asc(p), F.asc(key))
    later = ranked.groupBy("_range").agg(F.min("_raw").alias("_low"))
    after = F.min("_low").over(W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1))
    rest = later.select(F.col("_range").alias("_r"), after.alias("_after"))  # one row for each range
    # from the end on: a frame that reaches to the end of its range is computed anew for every row, which costs the range's square
    own = F.min("_raw").over(W.partitionBy("_range").orderBy(F.desc(p), F.desc(key)).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = ranked.join(F.broadcast(rest), F.col("_range") == F.col("_r")).withColumn("q", F.least(F.lit(1.0), own, F.col("_after")))
    return out.drop("_one", "before", "_n", "_raw", "_range", "_r", "_after")


def average_precision(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """One row ``n, positives, ap``: by score downwards, ties by ``key``; 0 without positives."""
    df = df.withColumn("_one", F.lit(1)).withColumn("_hit", F.col(label).cast("long"))
    seen = running_total(df, score, "_one", ties=[key], descending=True).withColumnRenamed("before", "_seen")
    hits = running_total(seen, score, "_hit", ties=[key], descending=True)
    precision = F.when(F.col("_hit") == 1, (F.col("before") + 1) / (F.col("_seen") + 1))
    return hits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("positives"), F.coalesce(F.avg(precision), F.lit(0.0)).alias("ap"))


def median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "med") -> DataFrame:
    """Per group the exact median, from running counts of the distinct values; no group is gathered.

    In a large table only the values between two bounds by the middle are counted one by one, the smaller ones together.
    """
    df = held(narrow(df, df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))))
    if df.count() > RANGE_ROWS and isinstance(df.schema["_v"].dataType, T.NumericType):
        bounds = df.groupBy(*by).agg(F.percentile_approx("_v", [0.5 - MARGIN, 0.5 + MARGIN], int(2 / MARGIN)).alias("_e"))
        bounds = held(bounds.select(*[F.col(b).alias(f"_e_{b}") for b in by], F.get("_e", F.lit(0)).alias("_lo"), F.get("_e", F.lit(1)).alias("_hi")))
        x = df.join(bounds, _same(by, "_e_")) if by else df.crossJoin(F.broadcast(bounds))  # one row
        # the values under the bounds are one null, which stands first; those above only count for the total
        place = F.when(F.col("_v") > F.col("_hi"), F.lit(2)).when(F.col("_v") >= F.col("_lo"), F.lit(1)).otherwise(0)
        found = held(_middle(held(x.groupBy(*by, place.alias("_p"), F.when(place == 1, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))), by, name))
        if found.where(F.col(name).isNull()).isEmpty():
            return found
    return _middle(df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k")), by, name)


def _same(by: Sequence[str], prefix: str) -> Column:
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"{prefix}{b}"))
    return match


def _middle(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The median of values ``_v`` that occur ``_k`` times; rows whose place ``_p`` is 2 are above all of them."""
    total = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    some = narrow(counts, counts.where("_p < 2").drop("_p")) if "_p" in counts.columns else counts
    x = running_total(some, "_v", "_k", by).join(total.select(*[F.col(b).alias(f"_t_{b}") for b in by], "_n"), _same(by, "_t_"))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_k")), F.col("_v")))
    return x.groupBy(*by).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))


def median_mad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group ``med`` and ``mad``, the median distance from it."""
    df = held(narrow(df, df.select(*by, value)))
    centre = held(median(df, value, by))
    joined = df.join(centre, list(by)) if by else df.crossJoin(F.broadcast(centre))  # one row
    far = median(narrow(df, joined.withColumn("_far", F.abs(F.col(value) - F.col("med")))), "_far", by, "mad")
    return centre.join(far, list(by)) if by else centre.crossJoin(F.broadcast(far))


def equal_bins(df: DataFrame, order: str, ties: Sequence[str], bins: int) -> DataFrame:
    """``df`` with ``bin``: bin b holds the rows [b·n//bins, (b+1)·n//bins) of the order."""
    df = held(df)
    n = df.count()
    at = lambda before: F.floor(((before + 1) * bins - 1) / F.lit(n))
    known = _zones(df, order, n, bins) if n > RANGE_ROWS and bins <= MAX_SKETCHED else None
    if known is None:
        return running_total(narrow(df, df.withColumn("_one", F.lit(1))), order, "_one", ties=ties).withColumn("bin", at(F.col("before"))).drop("_one", "before")
    zone, starts = known
    first = F.get(F.array(*[F.lit(s) for s in starts]), F.col("_zone"))
    x = df.withColumn("_zone", zone)
    inner = narrow(df, x.where("_zone % 2 = 1").withColumn("_one", F.lit(1)))
    inner = held(running_total(inner, order, "_one", ["_zone"], ties).withColumn("bin", at(F.col("before") + first)).select(*df.columns, "bin"))
    return narrow(df, x.where("_zone % 2 = 0").withColumn("bin", at(first)).select(*df.columns, "bin").unionByName(inner))


def _zones(df: DataFrame, order: str, n: int, bins: int) -> tuple[Column, list[int]] | None:
    """Each row's zone and the rows before each zone: the odd ones hold the cuts between bins, of the even ones each lies in one bin.

    None where the order is not of numbers, has missing ones, or the sketch missed a cut.
    """
    if not isinstance(df.schema[order].dataType, T.NumericType) or df.where(F.col(order).isNull() | F.isnan(F.col(order).cast("double"))).count():
        return None
    cuts = [b * n // bins for b in range(1, bins)]
    asked = [min(1.0, max(0.0, (c + 1) / n + sign * MARGIN)) for c in cuts for sign in (-1, 1)]
    if not asked:
        return F.lit(0), [0]
    got, spans = df.agg(F.percentile_approx(order, asked, int(2 / MARGIN))).first()[0], []
    for low, high in zip(got[::2], got[1::2], strict=True):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])

    def zoned(first: int, last: int) -> Column:
        # a tree of comparisons, which stays short enough to be compiled
        if first == last:
            return F.lit(first)
        at = (first + last) // 2
        passed = F.col(order) > spans[at // 2][1] if at % 2 else F.col(order) >= spans[at // 2][0]
        return F.when(passed, zoned(at + 1, last)).otherwise(zoned(first, at))

    zone = zoned(0, 2 * len(spans))
    counts = {r["z"]: r["n"] for r in df.groupBy(zone.alias("z")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two or three for each bin
    starts = [0]
    for z in range(2 * len(spans)):
        starts.append(starts[-1] + counts.get(z, 0))
    if any(not any(starts[z] <= c < starts[z + 1] for z in range(1, 2 * len(spans), 2)) for c in cuts):
        return None
    return zone, starts


def spread_trend(df: DataFrame, mean: str, value: str, key: str, bins: int = 30) -> DataFrame:
    """Per bin of equal count along ``mean``: ``bin, centre, spread`` (1.4826·MAD, 1e-9 if that is 0)."""
    placed = equal_bins(narrow(df, df.select(mean, value, key)), mean, [value, key], bins)
    binned = held(placed.select("bin", mean, value))
    spread = median_mad(narrow(binned, binned.select("bin", value)), value, ["bin"])
    centres = binned.groupBy("bin").agg(F.avg(mean).alias("centre"))
    width = F.when(F.col("mad") == 0, 1e-9).otherwise(1.4826 * F.col("mad"))
    return centres.join(spread, "bin").select("bin", "centre", width.alias("spread"))


def interpolate(df: DataFrame, at: str, trend: DataFrame, out: str) -> DataFrame:
    """``out``: the trend at ``at`` by straight lines between bin centres, held constant beyond them.

    The trend has one row per bin, so the driver reads it and makes a tree of comparisons of it.
    """
    points = [tuple(r) for r in trend.select(F.col("centre").cast("double"), F.col("spread").cast("double")).orderBy("centre", "spread").collect()]
    x = F.col(at)

    def line(below: int) -> Column:
        if not points:
            return F.lit(None).cast("double")
        if below in (0, len(points)):
            return F.lit(points[max(0, below - 1)][1])
        (c, v), (d, w) = points[below - 1 : below + 1]
        return v + F.lit(w - v) * (x - c) / F.lit(d - c)

    def under(first: int, last: int) -> Column:
        # by the number of centres up to x
        if first == last:
            return line(first)
        middle = (first + last) // 2
        return F.when(x >= points[middle][0], under(middle + 1, last)).otherwise(under(first, middle))

    return df.withColumn(out, under(0, len(points)))


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 2000, alpha: float = 0.05, seed: str = "boot") -> DataFrame:
    """Percentile interval ``lo, hi`` of the mean over resamples in which each row occurs a Poisson(1) number of times.

    The number comes from the MD5 of seed, key and resample, so the resamples are sums in one pass: no row is moved or joined.
    """
    pick = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("b").cast("string")))
    u = F.conv(F.substring(pick, 1, 13), 16, 10).cast("double") / float(1 << 52)
    edges = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    times = sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    sums = rows.select("b", "v", times.alias("k")).groupBy("b").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("m"))
    ordered = F.sort_array(F.collect_list("m"))  # one number per resample
    low, high = int(alpha / 2 * resamples), min(resamples - 1, int((1 - alpha / 2) * resamples))
    return sums.agg(ordered.alias("o")).select(F.get("o", F.lit(low)).alias("lo"), F.get("o", F.lit(high)).alias("hi"))


def slope(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope; 0 for fewer than two points."""
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


def zscore(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``z`` by group mean and population deviation (a deviation of 0 counts as 1)."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return df.join(stats, list(by)).withColumn("z", (F.col(value) - F.col("_m")) / sd).drop("_m", "_s")
