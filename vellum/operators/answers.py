"""Grounded answers: numbered passages as a model reads them, and what an answer cites of them. The answer's text is an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import sanitized, without_think
from vellum.operators.search import relative_cut, separation

ABSTAINS, SHOWN = "not documented", 1500


def passages(hits: DataFrame, k: int, score: str = "score", least: float = 0.0, min_keep: int = 3) -> DataFrame:
    """``hits`` (``query_id, key, score`` and texts) cut to what an answer may use, numbered ``n`` from 1: the ``k`` best, then those
    at ``least`` or more by ``score``, then what stands before the knee of ``score`` (three at least)."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), "key")
    best = hits.withColumn("r_", F.row_number().over(order)).where((F.col("r_") <= k) & (F.coalesce(F.col(score), F.lit(0.0)) >= least))
    ranked = best.withColumn("pos", F.row_number().over(order) - 1).drop("r_")
    kept = relative_cut(ranked, separation(ranked.select("query_id", F.col(score).alias("score"), "key"), "query_id", min_keep), "query_id")
    return kept.withColumn("n", (F.col("pos") + 1).cast("int")).drop("pos")


def passage_text(n: Column, title: Column, heading: Column, text: Column, test_key: Column | None = None) -> Column:
    """``[n] title › heading`` over the text, without instructions that the text may hide."""
    head = F.trim(F.coalesce(heading, F.lit("")))
    label = F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.when((head != "") & (head != title), F.concat(F.lit(" › "), head)).otherwise(""))
    if test_key is not None:
        label = F.concat(label, F.coalesce(F.concat(F.lit("  (test "), test_key, F.lit(")")), F.lit("")))
    return F.concat(label, F.lit("\n"), sanitized(F.coalesce(text, F.lit(""))))


def contexts(numbered: DataFrame) -> DataFrame:
    """``query_id, n_passages, context``: each question's passages (``n, title, heading, text``) as one text, in order."""
    shown = passage_text(F.col("n"), F.coalesce("title", F.lit("untitled")), F.col("heading"), F.col("text"), F.col("test_key") if "test_key" in numbered.columns else None)
    parts = F.array_sort(F.collect_list(F.struct("n", shown.alias("t"))))
    return numbered.groupBy("query_id").agg(F.count("*").alias("n_passages"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("context"))


def grounded(answers: DataFrame, numbered: DataFrame) -> DataFrame:
    """``query_id, cited, abstained, grounded`` of answers (``query_id, answer``): the passages cited that there are, whether the answer
    says that nothing is documented (also where there was no passage), and whether it rests on a passage."""
    sizes = numbered.groupBy("query_id").agg(F.max("n").alias("most"))
    text = without_think(F.coalesce("answer", F.lit("")))
    j = answers.join(sizes, "query_id", "left").withColumns({"text": text, "most": F.coalesce("most", F.lit(0))})
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    cited = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("most")))))
    abstains = (F.col("most") == 0) | F.lower("text").startswith(ABSTAINS)
    return j.select("query_id", cited.alias("cited"), abstains.alias("abstained"), ((F.size(cited) > 0) & ~abstains).alias("grounded"))


def citations(numbered: DataFrame, judged: DataFrame) -> DataFrame:
    """The passages that each answer cites: ``query_id, n, key, title, heading, score`` (4 digits) and the start of the text."""
    used = judged.select("query_id", F.explode("cited").alias("n"))
    return numbered.join(used, ["query_id", "n"]).select("query_id", "n", "key", "title", "heading", F.round("score", 4).alias("score"), F.substring("text", 1, SHOWN).alias("text"))
