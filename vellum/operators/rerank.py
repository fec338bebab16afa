"""Two-stage search: fetch more than asked for, then order by a scorer of (query, document) pairs.

A scorer is a class (or any factory without arguments) whose instances take a list of pairs and return a number each. It is
made once a task, so a model is loaded once and scores Arrow batches; ranking stays in Spark."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The model reads so many tokens, of which so many are the query's, at so many characters each.
TOKENS, QUERY_TOKENS, CHARS_PER_TOKEN = 512, 128, 3.5
BUDGET = int((TOKENS - QUERY_TOKENS) * CHARS_PER_TOKEN)
BODY, EXTRA = ("chunk_text", "summary", "_text"), (("description", 400), ("steps_text", 300))


def fetch_size(k: int, purpose: str = "search", pool: int = 0) -> int:
    """How many candidates to fetch for ``k`` results: for a search, an answer, a validation, or the preview of a pool."""
    return {"search": 3 * k, "answer": min(4 * k, 50), "validate": min(5 * k, 50), "preview": min(pool, 100)}[purpose]


class LexicalOverlap:
    """Share of the query's distinct words that the document has; the scorer where no model is at hand."""

    def __init__(self) -> None:
        self.words, self.of = regex.compile(r"[\p{L}\p{N}]+"), {}

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            if query not in self.of:
                self.of = {query: set(self.words.findall(query.lower()))}  # a task's rows come query by query
            asked = self.of[query]
            out.append(len(asked.intersection(self.words.findall(text.lower()))) / len(asked) if asked else 0.0)
        return out


def document_text(rows: DataFrame, budget: int = BUDGET) -> Column:
    """What a scorer reads of a row: the first body that isn't blank (else title and heading), then the start of the description
    and the steps as far as the budget goes."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    has = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    named = [F.nullif(F.col(c), F.lit("")) for c in ("doc_title", "section_heading") if c in rows.columns]
    body = F.coalesce(*[has(c) for c in BODY if c in rows.columns], F.concat_ws(" ", *named) if named else F.lit(""))
    parts = [F.substring(body, 1, budget)]
    left = F.lit(budget) - F.length(parts[0])
    for name, share in EXTRA:
        if name in rows.columns:
            part = F.substring(F.coalesce(strip(F.col(name)), F.lit("")), F.lit(1), F.least(F.lit(share), left))
            parts.append(part)
            left = left - F.length(part)
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def rerank(candidates: DataFrame, scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], k: int | None = None) -> DataFrame:
    """``candidates`` (``query_id, query, rank`` and texts) with ``rerank_score`` (4 digits), ``empty_text`` and their new ``rank``.

    Equal scores keep their order. Candidates of a null or blank query pass as they are, with a score of null. ``empty_text`` marks rows
    without any text, whose scores say nothing."""
    text = "reranked_text"
    rows = candidates.withColumn(text, document_text(candidates))
    schema = rows.schema.add("rerank_score", "double")

    def score(batches):
        made = scorer()
        for batch in batches:
            queries, texts = batch.column("query").to_pylist(), batch.column(text).to_pylist()
            at = [n for n, q in enumerate(queries) if q and q.strip()]
            scores: list[float | None] = [None] * len(queries)
            for n, x in zip(at, made([(queries[n], texts[n]) for n in at]) if at else [], strict=True):
                scores[n] = round(float(x), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "rerank_score"])

    scored = rows.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    ranked = scored.withColumns({"rank": F.row_number().over(order).cast("long"), "empty_text": F.col(text) == ""}).drop(text)
    return ranked if k is None else ranked.where(F.col("rank") <= k)
