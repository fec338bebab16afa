"""Mixing sources to target weights (operator 5): soft membership and projected least squares.

A softmax classifier, fitted to a bounded sample of labelled documents (``SAMPLE``, by hash of the
id), gives every document a posterior over the domains ``clean``, ``low`` and ``toxic`` of the
labels. A document of t words then carries t * p_k expected words of domain k. Rates x >= 0 a
document are fitted so that the expected words of each domain match target weights of the total:
projected gradient descent on the squared misfit, from x = 1. The misfit is weighted by the inverse of
the domains' second moments over documents with a rate above 0, which makes a step exact wherever no rate is
cut off at 0, so a few dozen steps end with each domain's misfit below ``CLOSE`` of its own target.

Documents whose posteriors round to the same ``STEPS``-ths share a cell and its rate. A cell carries the exact sums
of its documents' words and expected words, so the fitted totals are those of the unrounded posteriors.
The descent runs over the bounded table of cells, as Spark aggregations whose only way back is a few sums a
step; each cell's rate is the fold of the steps so far. A text is read once: it meets its copies in the table that its
posterior is written to.

Defined results: null and empty texts have 0 words and the posterior of no features, and get
the rate of that posterior; a very long text counts whole; rows of labels that meet no document, or with null labels,
are left out; several labels of a document all count; with no usable labels all documents are alike, a third of each domain;
domains that have no words keep a misfit, which is returned; repeated rows are separate documents, with equal rates
and copies; a null ``doc_id`` is mixed like any other; an empty table gives an empty result; ``rates`` ignores extra
columns, ``mix`` keeps them, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vellum.llm.common import by_value, free_name, persist, persist_batched, table

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.92, "low": 0.03, "toxic": 0.05}  # reachable without dropping clean documents: their posteriors of the others keep some mass
SAMPLE, SLOTS, CHOSEN, STEPS, ITERATIONS, CLOSE = 8_000, 1 << 16, 192, 200, 300, 1e-3
_SYMBOLS, _UPPER = re.compile(r"[#*$%&<>|!]"), re.compile(r"[A-Z]")


def features(text: str | None) -> tuple[int, np.ndarray, list[float]]:
    """Number of words; hashed distinct words (lower case, without outer punctuation); style."""
    words = text.split(None) if text else []
    slots = np.unique(np.fromiter((xxhash.xxh32_intdigest(w) % SLOTS for w in {w.strip(".,;:!?\"'()[]").lower() for w in words}), np.int64))
    n, chars = len(words), max(1, len(text or ""))
    once = len(set(words)) / max(1, n)
    return n, slots, [1.0, len(_SYMBOLS.findall(text or "")) / chars * 5, len(_UPPER.findall(text or "")) / chars * 5, once, float(once < 0.3), float(n < 50)]


def _sampled(batches):
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        arrays = [pa.array([x[1].tolist() for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("domain"), *arrays], names=["draw", "domain", "slots", "style"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Chosen slots and softmax weights (style first, then one row a slot)."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"), domain.alias("domain"))
    known = persist(known.orderBy(F.xxhash64("label_id"), "label_id", "domain").limit(SAMPLE), "known")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select(F.xxhash64("doc_id", "text", "domain").alias("draw"), "domain", "text")  # at most SAMPLE labels
    sample = rows.mapInArrow(_sampled, "draw long, domain int, slots array<int>, style array<double>").orderBy("draw").limit(4 * SAMPLE).toArrow()
    y = sample.column("domain").to_numpy()
    if not len(y):
        return np.empty(0, np.int64), np.zeros((6, len(DOMAINS)))
    lists = sample.column("slots").combine_chunks()
    slots, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(y)), lengths)
    counts = np.stack([np.bincount(slots[y[owner] == k], minlength=SLOTS) for k in range(len(DOMAINS))])
    of = np.bincount(y, minlength=len(DOMAINS))
    total, z = counts.sum(0), np.zeros(SLOTS)
    for k in range(1, len(DOMAINS)):  # how far each word's share in a domain is from chance
        share = of[k] / len(y)
        z = np.maximum(z, np.abs(counts[k] - total * share) / np.sqrt(total * share * (1 - share) + 1))
    chosen = np.sort(np.argsort(-z, kind="stable")[:CHOSEN])
    x = np.zeros((len(y), 6 + len(chosen)), np.float32)
    x[:, :6] = np.array(sample.column("style").to_pylist())
    at = np.searchsorted(chosen, slots)
    hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == slots)
    x[owner[hit], 6 + at[hit]] = 1
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    once, rate = np.eye(len(DOMAINS), dtype=np.float32)[y], np.full_like(w, 1e-6)
    for _ in range(400):
        g = x.T @ (softmax(x @ w) - once) / len(y) + 1e-4 * w
        rate += g * g
        w -= 0.5 * g / np.sqrt(rate)
    return chosen, w.astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _posteriors(chosen: np.ndarray, weights: np.ndarray, text_at: int):
    """Adds words and posteriors to rows; the text is their column ``text_at``."""

    def run(batches):
        row = np.full(SLOTS, -1)
        row[chosen] = np.arange(len(chosen)) + 6
        for batch in batches:
            found = [features(t) for t in batch.column(text_at).to_pylist()]
            z = np.array([np.array(style) @ weights[:6] + weights[r[r >= 0]].sum(0) for _, slots, style in found for r in (row[slots],)]).reshape(-1, weights.shape[1])
            p = softmax(z) if len(z) else z
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.int64()), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))],
                names=[*batch.schema.names, *(f"new {k}" for k in range(len(DOMAINS) + 1))],
            )

    return run


def _rate(history: list[list[float]]):
    """The rate after these steps: x = max(0, x - step . p), from 1, of the columns ``p_<domain>``."""
    past = F.array(*[F.struct(*[F.lit(float(s)).alias(d) for d, s in zip(DOMAINS, step, strict=True)]) for step in history])
    down = lambda x, h: F.greatest(F.lit(0.0), x - sum((h[d] * F.col(f"p_{d}") for d in DOMAINS), F.lit(0.0)))
    return F.aggregate(past, F.lit(1.0), down) if history else F.lit(1.0)


def fit_rates(cells: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], float]:
    """The descent's steps and the largest misfit left, relative to a domain's target; from cells (``p_<domain>``,
    ``words_<domain>``: expected words)."""
    sums = [F.sum(F.col(f"words_{d}") * F.col("rate")) for d in DOMAINS]
    gram = [F.sum(F.when(F.col("rate") > 0, F.col(f"words_{a}") * F.col(f"p_{b}")).otherwise(0.0)) for a in DOMAINS for b in DOMAINS]
    total = cells.agg(*[F.sum(f"words_{d}") for d in DOMAINS]).first()
    goal = np.array([targets[d] for d in DOMAINS]) * sum(x or 0.0 for x in total)
    if not goal.any():
        return [], 0.0
    history: list[list[float]] = []
    best, kept, damp = np.inf, 0, 1.0
    for _ in range(ITERATIONS):
        found = np.array(cells.withColumn("rate", _rate(history)).agg(*sums, *gram).first(), float)
        residual, g = found[: len(DOMAINS)] - goal, found[len(DOMAINS) :].reshape(len(DOMAINS), -1)
        misfit = float(np.abs(residual / np.maximum(goal, 1e-9)).max())
        if misfit < 0.999 * best:
            best, kept = misfit, len(history)
        elif len(history) - kept >= 20:
            break  # no better for long: the targets can't be met
        else:
            damp = max(damp / 2, 1 / 64)
        if misfit <= CLOSE:
            break
        history.append((damp * np.linalg.pinv(g, rcond=1e-9, hermitian=True) @ residual).tolist())
    return history[:kept], best


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with words and posteriors, written, and the names of the new columns (ones ``docs`` doesn't have)."""
    names = [free_name(docs, f"mix_{x}") for x in ("words", *DOMAINS)]
    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), *(StructField(n, DoubleType()) for n in names[1:])])
    return persist_batched(docs.mapInArrow(_posteriors(*fit(docs, labels), [c.lower() for c in docs.columns].index("text")), schema), "posteriors"), names


def _rated(scored: DataFrame, names: list[str], targets: dict[str, float]) -> tuple[DataFrame, str, float]:
    """``scored`` with each row's rate, that column's name, and the misfit left."""
    words, *ps = names
    cell = [free_name(scored, f"cell_{d}") for d in DOMAINS]
    keyed = scored.withColumns({c: F.round(F.col(p) * STEPS).cast("int") for c, p in zip(cell, ps, strict=True)})
    grouped = keyed.groupBy(*cell).agg(F.sum(words).alias("words"), F.count("*").alias("n"), *[F.sum(p).alias(f"sum_{d}") for d, p in zip(DOMAINS, ps, strict=True)],
        *[F.sum(F.col(words) * F.col(p)).alias(f"words_{d}") for d, p in zip(DOMAINS, ps, strict=True)])
    mean = {f"p_{d}": F.when(F.col("words") > 0, F.col(f"words_{d}") / F.col("words")).otherwise(F.col(f"sum_{d}") / F.col("n")) for d in DOMAINS}
    cells = persist(grouped.withColumns(mean).coalesce(1), "cells")  # at most (STEPS + 2) ** 2 / 2 cells, whatever the corpus
    history, misfit = fit_rates(cells, targets)
    rate = free_name(keyed, "mix_rate")
    rates_of = persist(cells.select(*[F.col(c).alias(f"of {d}") for c, d in zip(cell, DOMAINS, strict=True)], _rate(history).alias(rate)), "rates")
    same = [keyed[c].eqNullSafe(rates_of[f"of {d}"]) for c, d in zip(cell, DOMAINS, strict=True)]
    rated = keyed.join(F.broadcast(rates_of), same).drop(*cell, *[f"of {d}" for d in DOMAINS])
    return rated, rate, misfit


def _copies(rate: str):
    """The rate rounded up or down by a hash of the id, so that its expectation is the rate."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, n_words``, posteriors ``p_<domain>``, ``rate``, ``copies`` and ``misfit``: how far the expected
    words of the worst domain stay from its target, relative to it (the same in all rows)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, text string, n_words long, " + ", ".join(f"mix_{d} double" for d in DOMAINS)
    scored = persist(docs.mapInArrow(_posteriors(*fit(docs, labels), 1), schema).drop("text"), "posteriors")
    rated, rate, misfit = _rated(scored, ["n_words", *(f"mix_{d}" for d in DOMAINS)], targets)
    return rated.select("doc_id", "n_words", *[F.col(f"mix_{d}").alias(f"p_{d}") for d in DOMAINS], F.col(rate).alias("rate"), _copies(rate).alias("copies"), F.lit(misfit).alias("misfit"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Each row of ``docs`` as often as its copies say, by rate."""
    scored, names = _scored(docs, labels)
    rated, rate, _ = _rated(scored, names, targets)
    often = free_name(rated, "mix_copy")
    return rated.withColumn(often, F.explode(F.array_repeat(F.lit(0), _copies(rate)))).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


by_value(__name__)
