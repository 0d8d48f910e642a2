"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; each path from a root becomes a
rule (a conjunction of ``statistic <= cut`` / ``statistic > cut``); a lasso logistic regression keeps the
few rules that matter; the kept rules are compiled into one Spark column expression, so that scoring is
a single pass over the texts with built-in functions, without a shuffle.

Defined results: a null text is an empty text; every row is scored, repeated rows alike; ids and other
columns are carried through untouched and never enter a score, whatever their names; an empty table gives
no rows; with no labelled row of one class, or too few to part, the score is the (smoothed) share of good labels
everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_fold, quoted

#: Rows of the labelled sample that the rules are fitted on, at most (about; a hash threshold picks them).
SAMPLE_ROWS = 20_000
_PARTS, _STATS = "__quality_parts", "__quality_stats"


def text_statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The statistics that rules look at, by name, from a text, its words and its non-empty lines."""
    per_char = F.greatest(F.length(t), F.lit(1)).cast("double")
    per_word = F.greatest(F.size(words), F.lit(1)).cast("double")
    per_line = F.greatest(F.size(lines), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(t) / per_word,
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / per_line,
        "words_per_line": F.size(words) / per_line,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / per_word,
        "capitals": count(r"\p{Lu}+") / per_word,
        "digits": count("[0-9]+") / per_word,
        "symbols": count(r"[#$%&*|~^<>{}\[\]_=+@/\\]+") / per_word,
    }


@dataclass
class RuleModel:
    """Kept rules: conjunctions of (statistic, is_above, cut), their weights and the intercept."""

    names: list[str]
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self, stat) -> Column:
        """The score as a column; ``stat(name)`` gives the column of a statistic."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for k, above, cut in rule:
                test = stat(self.names[k]) > F.lit(cut) if above else stat(self.names[k]) <= F.lit(cut)
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same score in numpy, for tests."""
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * _holds(rule, x)
        return 1.0 / (1.0 + np.exp(-total))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _grow(bins, edges, grad, hess, rows, path, depth, rules, value, shrink):
    """One tree over binned statistics; appends every path and adds the leaves to ``value``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth:
        for k in range(bins.shape[1]):
            n = len(edges[k]) + 1
            gs = np.cumsum(np.bincount(bins[rows, k], grad[rows], n))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, k], hess[rows], n))[:-1]
            fine = (hs > 2.0) & (h - hs > 2.0)
            if fine.any():
                gain = np.where(fine, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, at))
    if best[1] is None:
        value[rows] += shrink * g / (h + 1)
        return
    k, at = best[1]
    left = bins[rows, k] <= at
    for above, part in ((False, rows[left]), (True, rows[~left])):
        test = (*path, (k, above, float(edges[k][at])))
        rules.add(tuple(sorted(test)))
        _grow(bins, edges, grad, hess, part, test, depth - 1, rules, value, shrink)


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleModel:
    """Trees -> rules -> lasso logistic weights. Deterministic for the same rows in the same order."""
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    model = RuleModel(names, intercept=float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    value, rules, everything = np.full(len(y), model.intercept), set(), np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        _grow(bins, edges, y - p, p * (1 - p), everything, (), depth, rules, value, 0.3)
    kept, columns, seen = [], [], set()
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        held = _holds(rule, x)
        if (key := held.tobytes()) not in seen and 0 < held.sum() < len(y):
            seen.add(key)
            kept.append(rule)
            columns.append(held)
    if not kept:  # too few rows to part
        return model
    z = np.stack(columns, axis=1).astype(np.float32)
    # Proximal gradient with momentum on the mean logistic loss; the intercept is not penalised.
    w = last = np.zeros(z.shape[1], dtype=np.float64)
    b, b_last, rate = model.intercept, model.intercept, 4.0 / max(1.0, float((z**2).sum(axis=1).mean()) + 1)
    for k in range(steps):
        m = k / (k + 3.0)
        v, c = w + m * (w - last), b + m * (b - b_last)
        r = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + c))) - y
        grad = (z.T @ r.astype(np.float32)).astype(np.float64) / len(y)
        last, b_last = w, b
        w, b = v - rate * grad, c - rate * r.mean()
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
    on = np.flatnonzero(np.abs(w) > 1e-6)
    model.rules, model.weights, model.intercept = [kept[i] for i in on], [float(w[i]) for i in on], float(b)
    return model


def _with_statistics(docs: DataFrame, text: str) -> DataFrame:
    # Generators of one row: the words are split once, and the statistics aren't written into each rule again.
    bare = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(bare, "\n"), lambda x: F.length(x) > 0)
    # A plain replace and a one-character split are several times as fast as a pattern for white space.
    words = F.split(F.replace(F.replace(bare, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " ")
    parts = F.struct(bare.alias("t"), words.alias("words"), lines.alias("lines"))
    stats = text_statistics(*[F.col(f"{_PARTS}.{x}") for x in ("t", "words", "lines")])
    packed = F.struct(*[c.cast("double").alias(n) for n, c in stats.items()])
    return docs.select("*", F.explode(F.array(parts)).alias(_PARTS)).select(*quoted(docs.columns), F.explode(F.array(packed)).alias(_STATS))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on labelled rows outside the held-out fold. ``labels``: doc_id, quality; rows without either,
    and ids with conflicting labels, count with their rounded mean. At most about ``sample_rows`` rows,
    chosen by a hash of the id, reach the driver, one for each id; the join is against that bounded set."""
    names = list(text_statistics(F.lit(""), F.array(), F.array()))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("__label"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * sample_rows / total))
    sample = F.broadcast(known.withColumnRenamed("doc_id", "__id"))
    joined = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(sample, "__id")
    # A row for each labelled id, of its texts the one of the smallest hash: repeats of an id don't reach the driver.
    first = F.min(F.struct(F.xxhash64("__text").alias("h"), *[F.col(f"{_STATS}.{n}").alias(n) for n in names]))
    found = _with_statistics(joined, "__text").groupBy("__id", "__label").agg(first.alias("x"))
    rows = found.select("__id", "__label", *[F.col(f"x.{n}").alias(n) for n in names]).toPandas().sort_values("__id")
    if not len(rows):
        return RuleModel(names)
    return fit_rules(names, rows[names].to_numpy(np.float64), rows["__label"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, out: str = "score") -> DataFrame:
    """``docs`` with the model's score between 0 and 1 in column ``out``."""
    scored = _with_statistics(docs, "text")
    return scored.withColumn(out, model.column(lambda n: F.col(f"{_STATS}.{n}"))).drop(_STATS)
