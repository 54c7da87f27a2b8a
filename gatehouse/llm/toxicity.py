"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, a linear classifier.

1. Voters.  From a bounded sample of labelled training documents: words and word beginnings that mark toxic documents,
   and beginnings that occur twice or more (a likelihood ratio above what the number of candidates brings about by
   chance), plus fixed patterns of shouting and a voter for texts dense in lexicon hits.  Such a voter votes "toxic"
   where it fires and abstains elsewhere; two voters vote "clean", where hits are sparse and where there are none.
2. Label model.  A generative model of the votes: the class, and per voter the rate of firing in each class given
   whether the voter that it hangs on fires.  The dependencies are a tree, the strongest by conditional mutual
   information given the class, so accuracies and correlations are parameters of one model and near-copies of one voter
   do not count twice.  Expectation-maximisation fits both from how the votes agree, starting from the plain majority.
   Labels enter only as the share of toxic documents.  Voters that only ever vote one way would come out as never
   wrong, so every voter begins with ``doubt`` times its own votes that are right as often as ``trust``.
3. Classifier.  Logistic regression on counts and densities of the voters' hits, trained on the posterior labels with
   weights that undo the sample's stratification.  Last, the constant is moved so that 0.5 is the cut with the best F1
   on the training rows, in the middle of the gap around it.

Every document is then scored whole, in one narrow pass with an Aho-Corasick automaton over the lexicon.  Labels,
lang, source and ids are never inputs of a score.

Bounds (parameters of ``ToxicityConfig``), all on what is fitted: ``per_class`` labelled documents of each class, those
with the smallest hashed ids; ``max_voters`` lexicon voters; words of 3 to ``longest_word`` letters (longer ones count by
their beginnings).  Scoring has no bound.

Edge cases: null and empty texts have no hits and get the score of a text without hits; ids that have several label
rows count as toxic if one says so; label rows with null or other values are ignored; of several training texts with
one id the one with the smallest digest is fitted; without toxic or without clean training rows there are no voters and
every score is 0.0; a null id belongs to the held-out fold (the CRC-32 of an empty text is 0); repeated rows are scored
one by one; empty tables give empty results; extra columns pass through, except those named like a result column,
which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm._scratch import Scratch

_WORD = re.compile(r"\w+")
_PATTERNS = [re.compile(r"!{3,}"), re.compile(r"[?!]{4,}"), re.compile(r"(?:\b[A-Z]{4,}\b\W+){4}"), re.compile(r"(.)\1{5,}")]
#: Lexicon hits per word above and below which a text counts as dense or sparse.
_DENSE, _SPARSE = 0.01, 0.005


@dataclass(frozen=True)
class ToxicityConfig:
    per_class: int = 6000
    max_voters: int = 128
    min_support: int = 3
    min_log_odds: float = 2.0
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    longest_word: int = 40
    rounds: int = 30
    doubt: float = 0.25
    trust: float = 0.9
    ridge: float = 3e-4


@dataclass(frozen=True)
class ToxicityModel:
    """``words`` and ``beginnings`` are the lexicon; ``voters`` says from how many hits an entry votes."""

    words: list[str] = field(default_factory=list)
    beginnings: list[str] = field(default_factory=list)
    voters: list[tuple[int, int]] = field(default_factory=list)  # (entry, hits from which it fires)
    weights: list[float] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)

    @property
    def trained(self) -> bool:
        return bool(self.weights)


def fold(doc_id: Column) -> Column:
    """0 marks the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


class Hits:
    """Counts lexicon entries at word boundaries, and pattern hits."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.n, self.n_words = len(words) + len(beginnings), len(words)
        self.machine = ahocorasick.Automaton()
        entries: dict[str, list[int]] = {}
        for i, key in enumerate([*words, *beginnings]):
            entries.setdefault(key, []).append(i)
        for key, which in entries.items():
            self.machine.add_word(key, (len(key), which))
        if self.n:
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        """Hits per lexicon entry and pattern, and the number of words."""
        counts = np.zeros(self.n + len(_PATTERNS))
        if not text:
            return counts, 0
        low = text.lower()
        part = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        if self.n:
            for end, (size, which) in self.machine.iter(low):
                if part(end - size):
                    continue
                for i in which:
                    if i >= self.n_words or not part(end + 1):
                        counts[i] += 1
        for i, pattern in enumerate(_PATTERNS):
            counts[self.n + i] = sum(1 for _ in pattern.finditer(text))
        return counts, len(text.split())


def ballots(counts: np.ndarray, words: np.ndarray, voters: list[tuple[int, int]], n_lexicon: int) -> np.ndarray:
    """Rows x voters: do they fire?  Lexicon voters, patterns, one for many hits among few words; the last two vote "clean"."""
    fires = [counts[:, entry] >= least for entry, least in voters]
    total = counts[:, :n_lexicon].sum(axis=1)
    return np.column_stack([*fires, counts[:, n_lexicon:] > 0, total > _DENSE * words, (total > 0) & (total < _SPARSE * words), total == 0])


def features(counts: np.ndarray, words: np.ndarray, n_lexicon: int, voters: list[tuple[int, int]]) -> np.ndarray:
    """Rows of hit counts -> inputs of the classifier; the first is the constant."""
    total = counts[:, :n_lexicon].sum(axis=1)
    density = 100.0 * total / np.maximum(words, 1)
    fires = ballots(counts, words, voters, n_lexicon).astype(float)
    return np.column_stack([np.ones(len(counts)), np.log1p(total), np.log1p(density), np.log1p(counts[:, :n_lexicon]), fires])


@dataclass
class LabelModel:
    """Firing rates by class and by whether the parent fires; ``parent`` is -1 at the tree's root."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray  # class x parent fires x voter

    def log_ratio(self, fires: np.ndarray) -> np.ndarray:
        """What the voters that fire say for toxic, as log odds; a voter that abstains says nothing."""
        under = (self.parent >= 0) & fires[:, np.maximum(self.parent, 0)]
        ratio = np.log(self.rate[1] / self.rate[0])
        return np.where(fires, np.where(under, ratio[1], ratio[0]), 0.0).sum(axis=1)

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        return _logistic(math.log(self.prior / (1 - self.prior)) + self.log_ratio(fires))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _rates(fires: np.ndarray, parent: np.ndarray, weight: np.ndarray, share: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``rate[parent fires, voter]`` in the class that rows belong to with ``share``; voters have ``held`` votes beforehand."""
    mass = weight * share
    whole = (mass @ fires + held + 1e-3) / (mass.sum() + held + 1)
    under = fires[:, np.maximum(parent, 0)] & (parent >= 0)

    def rate(rows: np.ndarray, m: np.ndarray, lean: np.ndarray, towards: np.ndarray) -> np.ndarray:
        return ((m[:, None] * (rows & fires)).sum(axis=0) + lean * towards) / ((m[:, None] * rows).sum(axis=0) + lean)

    # where a parent fires, a class with few such rows leans on both classes together: copies of a voter then add nothing
    pooled = rate(under, weight, np.full(len(held), 1.0), whole)
    return np.clip(np.vstack([rate(~under, mass, 2 + held, whole), rate(under, mass, np.full(len(held), 5.0), pooled)]), 1e-6, 1 - 1e-6)


def _dependencies(fires: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree of the largest conditional mutual information given the class, -1 at its root."""
    n = fires.shape[1]
    gain = np.zeros((n, n))
    x = fires.astype(float)
    for mass in (weight * (1 - p), weight * p):
        total = max(mass.sum(), 1e-12)
        both = (x * mass[:, None]).T @ x / total
        one = np.diag(both)
        only = one[:, None] - both
        tables = ((both, one[:, None] * one), (only, one[:, None] * (1 - one)), (only.T, (1 - one)[:, None] * one), (1 - one[:, None] - only.T, (1 - one)[:, None] * (1 - one)))
        for joint, apart in tables:
            gain += total * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12)), 0.0)
    parent, best, source, todo = np.full(n, -1), np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        new = int(np.argmax(np.where(todo, best, -np.inf)))
        todo[new], parent[new] = False, source[new]
        closer = todo & (gain[new] > best)
        best[closer], source[closer] = gain[new][closer], new
    return parent


def label_model(
    fires: np.ndarray, toxic: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30, doubt: float = 0.25, trust: float = 0.9
) -> tuple[np.ndarray, np.ndarray, LabelModel]:
    """``fires`` rows x voters, ``toxic`` the side each voter votes for -> (posterior of toxic, accuracy per voter, model).

    Starts from the majority of the votes; a voter's accuracy is how often it is right where it fires.
    """
    for_toxic = fires[:, toxic].sum(axis=1)
    against = fires[:, ~toxic].sum(axis=1)
    p = np.where(for_toxic > against, 1 - 0.5 ** (1 + for_toxic), np.where(against > for_toxic, prior / 4, prior))
    own = doubt * (weight @ fires)
    held = np.where(toxic, 1 - trust, trust) * own, np.where(toxic, trust, 1 - trust) * own
    model = LabelModel(prior, np.full(fires.shape[1], -1), np.zeros((2, 2, fires.shape[1])))
    for n in range(rounds):
        if n in (0, 3, rounds // 2):
            # voters for "clean" are silent by definition where others speak: they hang on none
            model.parent[toxic] = np.append(np.flatnonzero(toxic), -1)[_dependencies(fires[:, toxic], p, weight)]
        model.rate = np.stack([_rates(fires, model.parent, weight, 1 - p, held[0]), _rates(fires, model.parent, weight, p, held[1])])
        # voters are better than chance: none may speak against its own side where it speaks alone
        low, high = model.rate[0], model.rate[1]
        wrong = np.where(toxic, high < low, high > low)
        model.rate = np.where(wrong, (low + high) / 2, model.rate)
        p = model.posterior(fires)
    cast = np.maximum((weight[:, None] * fires).sum(axis=0), 1e-12)
    right = (weight * p) @ fires / cast
    return p, np.where(toxic, right, 1 - right), model


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression on soft targets by damped Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-9
    for _ in range(60):
        p = _logistic(x @ w)
        gradient = x.T @ (weight * (p - target)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit of the best F1 on labelled rows, in the middle between the values on its two sides."""
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], (weight * toxic)[order]
    caught, called = np.cumsum(hit), np.cumsum(weight[order])
    last = np.append(z[1:] < z[:-1], True)  # equal logits fall on one side
    f1 = np.where(last, 2 * caught / (called + hit.sum()), -1.0)
    at = int(np.argmax(f1))
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)


def _sample(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Training texts ``(id, toxic, text)``, at most ``per_class`` of each class, and all training ids per class."""
    by_id = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in by_id.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [by_id.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.per_class) for c in (0, 1)]
    few = picked[0].union(picked[1]).select(F.col("doc_id").alias("l_id"), "toxic")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    met = texts.join(F.broadcast(few), F.col("id") == F.col("l_id"))
    # one text per id, so a repeated id brings no more rows
    return met.groupBy("id", "toxic").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")).alias("one")).select("id", "toxic", "one.text"), sizes


def _count_keys(cfg: ToxicityConfig):
    """Texts of each class that hold a word ("=", at least once) or a beginning ("1", "2": from so many hits)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(_WORD.findall((text or "").lower()))
                keys = ["=" + w for w in words if 3 <= len(w) <= cfg.longest_word]
                for n in cfg.beginnings:
                    starts: Counter = Counter()
                    for w, times in words.items():
                        if len(w) >= n:
                            starts[w[:n]] += times
                    keys += ["1" + s for s in starts]
                    keys += ["2" + s for s, times in starts.items() if times >= 2]
                seen[toxic].update(keys)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())],
            names=["key", "clean", "toxic"],
        )

    return count


def _choose(candidates: list[tuple[str, int, int]], cfg: ToxicityConfig) -> list[str]:
    """Entries, best first; one that begins like a chosen one, or the other way round, must reach more documents."""
    chosen: list[tuple[str, int]] = []
    for key, _, toxic in candidates:
        if len(chosen) == cfg.max_voters:
            break
        body = key[1:]
        kin = [t for c, t in chosen if body.startswith(c[1:]) or c[1:].startswith(body)]
        if all(toxic > 1.2 * t for t in kin):
            chosen.append((key, toxic))
    return [c for c, _ in chosen]


def train(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold; at most ``2 * cfg.per_class`` rows reach the driver as counts."""
    cfg = cfg or ToxicityConfig()
    scratch = Scratch(docs.sparkSession, "toxicity")
    picked, sizes = _sample(docs, labels, cfg, id_col, text_col)
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel()
    sample = scratch.save(picked, "sample")
    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not got.get(0) or not got.get(1):
        return ToxicityModel()
    counted = sample.select("toxic", "text").mapInArrow(_count_keys(cfg), "key string, clean long, toxic long")
    sums = scratch.save(counted.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= cfg.min_support), "sums")
    # candidates of a kind: whole words, or beginnings of one length and number of hits
    kind = F.when(F.col("key").startswith("="), F.lit("=")).otherwise(F.concat(F.substring("key", 1, 1), F.length("key")))
    sums = sums.withColumn("kind", kind)
    tried = sums.groupBy(F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("tried"))
    c, t, n0, n1 = F.col("clean"), F.col("toxic"), float(got[0]), float(got[1])
    lift = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    term = lambda seen, rate, mean: F.when(seen > 0, seen * F.log(rate / mean)).otherwise(0.0)
    mean = (c + t) / (n0 + n1)
    ratio = 2 * (term(t, t / n1, mean) + term(n1 - t, 1 - t / n1, 1 - mean) + term(c, c / n0, mean) + term(n0 - c, 1 - c / n0, 1 - mean))
    # by chance alone about one candidate of a kind reaches this ratio; there are a few kinds
    good = sums.join(F.broadcast(tried), F.col("kind") == F.col("k")).where((lift >= cfg.min_log_odds) & (ratio > 2 * F.log(F.greatest("tried", F.lit(2))))).withColumn("ratio", ratio)
    best = good.orderBy(F.desc(F.round("ratio", 6)), F.desc(F.col("key").startswith("=")), F.desc(F.length("key")), "key").limit(20 * cfg.max_voters)
    keys = _choose([(r["key"], r["clean"], r["toxic"]) for r in best.collect()], cfg)
    words = [k[1:] for k in keys if k[0] == "="]
    starts = list(dict.fromkeys(k[1:] for k in keys if k[0] != "="))
    place = {**{"=" + w: i for i, w in enumerate(words)}, **{s: len(words) + i for i, s in enumerate(starts)}}
    voters = [(place[k], 1) if k[0] == "=" else (place[k[1:]], int(k[0])) for k in keys]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(words, starts)
        for batch in batches:
            found = [hits(t) for t in batch.column(2).to_pylist()]
            counts = pa.array([c.tolist() for c, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array([n for _, n in found], pa.int64())], names=["id", "toxic", "counts", "words"])

    schema = T.StructType([sample.schema["id"], *T._parse_datatype_string("toxic int, counts array<double>, words long").fields])
    rows = sorted(sample.mapInArrow(count, schema).collect(), key=lambda r: (str(r["id"]), r["toxic"], r["words"], r["counts"]))
    scratch.close()
    counts, n_words = np.array([r["counts"] for r in rows]), np.array([r["words"] for r in rows], dtype=float)
    strata = np.array([r["toxic"] for r in rows])
    weight = np.where(strata == 1, sizes[1] / got[1], sizes[0] / got[0])
    n_lexicon = len(words) + len(starts)
    fires = ballots(counts, n_words, voters, n_lexicon)
    side = np.arange(fires.shape[1]) < fires.shape[1] - 2
    posterior, accuracy, _ = label_model(fires, side, weight, sizes[1] / (sizes[0] + sizes[1]), cfg.rounds, cfg.doubt, cfg.trust)
    x = features(counts, n_words, n_lexicon, voters)
    fitted = logistic(x, posterior, weight, cfg.ridge)
    fitted[0] -= best_cut(x @ fitted, strata, weight)
    return ToxicityModel(words, starts, voters, fitted.tolist(), accuracy.tolist())


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted") or c == text_col]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(kept)])
    at = kept.index(text_col)
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, weights = Hits(model.words, model.beginnings), np.array(model.weights)
        n_lexicon = len(model.words) + len(model.beginnings)
        for batch in batches:
            if model.trained and batch.num_rows:
                found = [hits(t.as_py()) for t in batch.column(at)]
                x = features(np.array([c for c, _ in found]), np.array([n for _, n in found], dtype=float), n_lexicon, model.voters)
                scores = _logistic(x @ weights)
            else:
                scores = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)

    scored = inner.mapInArrow(judge, schema)
    return scored.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
