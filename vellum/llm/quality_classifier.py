"""Quality classifier (operator 1): a sparse rule ensemble, compiled into Spark columns.

Statistics of the whole text are Spark columns. On a bounded sample of labelled documents
(``SAMPLE``, by hash of the id) small boosted trees are grown; every path from a root is a
conjunctive rule over the statistics. Lasso logistic regression over the rules keeps a few with
their weights, and those are compiled into one column expression: all documents are scored
by generated JVM code, in one scan without a shuffle.

Defined results: null text counts as empty and gets the score of its (zero) statistics; labels that
are null or meet no document are left out; repeated rows of either table count each (up to ``4 * SAMPLE``
pairs, drawn by hash of their statistics); with one class
only, the score is that class's share, smoothed; rules whose thresholds a statistic ties with hold on the lower side; a very
long text is read whole; extra columns are kept by ``score``, whose own column replaces one of its name; an empty table gives an
empty result. Ids, language, source and labels are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, WORD, let, persist, remainder, table

SAMPLE, TREES, DEPTH, LEAST, LASSO, BINS = 12_000, 24, 3, 20, 1e-3, 24
STATISTICS = ("n_words", "word_length", "symbol_rate", "pipe_rate", "bang_rate", "upper_rate", "digit_rate", "distinct_rate", "line_words", "dup_line_rate")


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text, doubles rounded so that thresholds are reproducible."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def of_words(w: Column) -> Column:
        n, one = F.size(w), F.greatest(F.size(w), F.lit(1))
        chars = F.greatest(F.length(text) - count(SPACE), F.lit(1))

        def of_lines(lines: Column) -> Column:
            some = F.greatest(F.size(lines), F.lit(1))
            values = (
                n, chars / one, count(r"[#*$%&<>]") / chars, count(r"\|") / one, count("!") / one, count(r"\p{Lu}") / chars, count(r"[0-9]") / chars,
                F.size(F.array_distinct(w)) / one, n / some, (F.size(lines) - F.size(F.array_distinct(lines))) / some,
            )
            return F.struct(*[F.round(v.cast("double"), 6).alias(k) for k, v in zip(STATISTICS, values, strict=True)])

        return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


@dataclass(frozen=True)
class Rules:
    """Conjunctions ((statistic, above, threshold), ...) with weights, and the intercept."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, above, at in rule:
                value = stats[STATISTICS[k]]
                test = test & ((value > at) if above else (value <= at))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix(x, self.rules)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + self.matrix(x) @ np.array(self.weights))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def rule_matrix(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, at in rule:
            out[:, j] *= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def _grow(x, residual, weight, rows, cuts, path, depth, rules, leaf_of):
    """Greedy tree on the gradient; appends each node's path to ``rules`` and sets the leaves' values."""
    g, h = residual[rows].sum(), weight[rows].sum()
    if path:
        rules.append(tuple(path))
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST:
        for k, points in enumerate(cuts):
            for at in points:
                left = x[rows, k] <= at
                n = left.sum()
                if LEAST <= n <= len(rows) - LEAST:
                    gl, hl = residual[rows[left]].sum(), weight[rows[left]].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (k, at, left))
    if best[1] is None:
        leaf_of[rows] = g / (h + 1)
        return
    k, at, left = best[1]
    _grow(x, residual, weight, rows[left], cuts, [*path, (k, False, at)], depth - 1, rules, leaf_of)
    _grow(x, residual, weight, rows[~left], cuts, [*path, (k, True, at)], depth - 1, rules, leaf_of)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list:
    """Distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(column, np.linspace(0.02, 0.98, BINS))).round(6).tolist() for column in x.T]
    margin, rules = np.zeros(len(x)), []
    for _ in range(TREES):
        p, leaf = _sigmoid(margin), np.zeros(len(x))
        _grow(x, y - p, p * (1 - p), np.arange(len(x)), cuts, [], DEPTH, rules, leaf)
        margin += 0.4 * leaf
    return list(dict.fromkeys(tuple(sorted(rule)) for rule in rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated proximal gradient; the intercept is not penalized."""
    z = np.hstack([z, np.ones((len(z), 1))])
    size = 4 * len(z) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        new = v - size * (z.T @ (_sigmoid(z @ v) - y)) / len(z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * strength, 0)
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Rules((), (), float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    z = rule_matrix(x, rules)
    w, b = lasso_logistic(z, y, LASSO)
    kept = np.flatnonzero(w)
    return Rules(tuple(rules[j] for j in kept), tuple(w[kept].tolist()), b)


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    """Learns from up to ``SAMPLE`` labels; ``labels`` has ``doc_id, quality``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    known = persist(known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(SAMPLE), "known")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most SAMPLE labels
    rows = rows.select("label", statistics(F.col("text")).alias("s")).select("label", "s.*").orderBy(F.xxhash64(*STATISTICS, "label"), *STATISTICS, "label").limit(4 * SAMPLE).toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), (rows["label"].to_numpy() == 1).astype(float))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` with ``score``: how likely the label 1 is."""
    return docs.withColumn("score", let(statistics(F.col("text")), rules.column))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    rules = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs, rules).select("doc_id", held_out.alias("held_out"), "score")
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
