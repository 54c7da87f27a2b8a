"""The rule engine: ordered, named rules over feature columns become verdicts in one narrow projection.

A rule has a name, a predicate, a message and a weight; weight 0 discloses without failing.  Evaluation adds
``reasons`` (contract, message, weight, in registration order), ``score`` (sum of weights), ``ok`` (score is 0),
``clean`` (no reasons), ``fired`` (names) and ``messages``.  A null predicate does not fire.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD, CALIBRATED = "hard", "calibrated"
_REASON = "struct<contract:string,message:string,weight:double>"


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column
    message: Column | str | None = None
    weight: float = 1.0
    kind: str = HARD

    def reason(self) -> Column:
        text = self.name if self.message is None else self.message
        message = F.lit(text) if isinstance(text, str) else text
        made = F.struct(F.lit(self.name).alias("contract"), message.alias("message"), F.lit(float(self.weight)).alias("weight"))
        return F.when(self.predicate, made.cast(_REASON))


@dataclass(frozen=True)
class RuleSet:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def add(self, *rules: Rule) -> RuleSet:
        return replace(self, rules=(*self.rules, *rules))

    def rule(self, name: str, predicate: Column, message: Column | str | None = None, weight: float = 1.0, kind: str = HARD) -> RuleSet:
        return self.add(Rule(name, predicate, message, weight, kind))

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def hard_only(self) -> RuleSet:
        return RuleSet(f"{self.name}[hard]", tuple(r for r in self.rules if r.kind == HARD))

    def evaluate(self, features: DataFrame) -> DataFrame:
        reasons = F.filter(F.array(*[r.reason() for r in self.rules]), lambda r: r.isNotNull()) if self.rules else F.array().cast(f"array<{_REASON}>")
        return with_verdict(features.withColumn("reasons", reasons))


def with_verdict(df: DataFrame) -> DataFrame:
    """The derived verdict columns of a frame that has ``reasons``."""
    score = F.aggregate("reasons", F.lit(0.0), lambda a, r: a + r.weight)
    fired, messages = F.transform("reasons", lambda r: r.contract), F.transform("reasons", lambda r: r.message)
    df = df.withColumn("score", score).withColumn("ok", F.col("score") == 0).withColumn("clean", F.size("reasons") == 0)
    return df.withColumn("fired", fired).withColumn("messages", messages)


def fuse(df: DataFrame, first: str, second: str) -> DataFrame:
    """One verdict of two ``reasons`` columns: the reasons of the first, then those of the second."""
    return with_verdict(df.withColumn("reasons", F.concat(F.col(first), F.col(second))))


def fire_rates(verdicts: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group and contract the share of rows it fired on; ``ANY`` is the share with any reason."""
    shares = [F.avg(F.array_contains("fired", n).cast("int")).alias(n) for n in names]
    wide = verdicts.groupBy(*by).agg(*shares, F.avg((~F.col("clean")).cast("int")).alias("ANY"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("contract"), F.col(n).alias("rate")) for n in [*names, "ANY"]]))
    return wide.select(*by, pairs.alias("p")).select(*by, "p.contract", "p.rate")


def tally_first_reason(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each text before the colon of the first message occurs; clean rows do not count."""
    first = F.split(F.get("messages", F.lit(0)), ":")
    return verdicts.where(~F.col("clean")).groupBy(*by, F.get(first, F.lit(0)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def set_verdict(verdicts: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """One row over a whole set: items, passed, and whether all pass; a condemning rule on the set itself fails it too."""
    passed = F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0))
    one = verdicts.agg(F.count(F.lit(1)).alias("items"), passed.alias("passed"), F.coalesce(F.every("ok"), F.lit(True)).alias("ok"))
    if batch is None:
        return one
    whole = batch.agg(F.coalesce(F.every("ok"), F.lit(True)).alias("_set"))
    return one.crossJoin(F.broadcast(whole)).withColumn("ok", F.col("ok") & F.col("_set")).drop("_set")  # one row each


def exceedance(value: Column, limit: Column | float) -> Column:
    """How far a value is above its limit, as a share of it; 0 below."""
    return F.greatest(value / limit - 1.0, F.lit(0.0))
