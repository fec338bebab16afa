"""Sections of documents and how decisions cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import is_meta_heading, normalized_heading
from vellum.operators.review import ACTIONS
from vellum.operators.sync import inherited

COUNTS = (*[f"{a}_count" for a in ACTIONS], "approved_count", "pending_count", "written_count")


def section_list(chunks: DataFrame) -> DataFrame:
    """``source_id, no, heading, n_words, kinds, testable``: the distinct headings of each document in their order, with the words under
    them, the chunk types as ``a/b`` ('?' without any), and whether the section holds requirements."""
    words = F.size(F.filter(F.split(F.trim("chunk_text"), r"\s+"), lambda x: x != ""))
    rows = inherited(chunks).withColumn("heading", F.coalesce("heading", F.lit("(no heading)")))
    kinds = F.array_join(F.array_sort(F.collect_set("chunk_type")), "/")
    out = rows.groupBy("source_id", "heading").agg(F.min("chunk_index").alias("first"), F.sum(words).cast("long").alias("n_words"), F.coalesce(F.nullif(kinds, F.lit("")), F.lit("?")).alias("kinds"))
    no = F.row_number().over(Window.partitionBy("source_id").orderBy("first", "heading"))
    return out.select("source_id", no.alias("no"), "heading", "n_words", "kinds", (~is_meta_heading(F.col("heading"))).alias("testable"))


def _gap_risk():
    n = lambda c: F.col(f"{c}_count") > 0
    return F.when(n("keep") | n("update"), "covered").when(n("create"), "unverified").when(n("deprecate"), "shrinking").when(n("question"), "questioned").otherwise("uncovered")


def section_coverage(sections: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a testable section with its counts, zeros included, and gap; the decisions' labels that name no testable section).

    Both sides are compared in normal form, within their document."""
    flag = {"approved_count": F.col("approved"), "pending_count": ~F.col("reviewed"), "written_count": F.col("written_back")}
    labelled = decisions.withColumn("key", normalized_heading(F.col("prd_section"))).where("key <> ''")
    counts = labelled.groupBy(F.col("prd_source").alias("source_id"), "key").agg(*[F.count_if(F.col("action") == a).alias(f"{a}_count") for a in ACTIONS], *[F.count_if(c).alias(k) for k, c in flag.items()], F.min("prd_section").alias("label"))
    listed = sections.where("testable").select("source_id", "no", "heading", normalized_heading(F.col("heading")).alias("key"))
    rows = listed.join(counts.drop("label"), ["source_id", "key"], "left").fillna(0, list(COUNTS))
    unmatched = counts.join(listed, ["source_id", "key"], "left_anti").select("source_id", "label")
    return rows.select("source_id", "no", "heading", *COUNTS, _gap_risk().alias("gap_risk")), unmatched


def coverage_scores(sections: DataFrame, decisions: DataFrame) -> DataFrame:
    """``source_id, n_testable, n_covered, coverage_score, unmatched``: the share of testable sections that a kept, updated or new test
    covers. Labels of no section don't count; they are listed, sorted. Null where a document has no testable section."""
    testable = sections.where("testable").select("source_id", normalized_heading(F.col("heading")).alias("key")).where("key <> ''").distinct()
    covered = decisions.where(F.col("action").isin("keep", "update", "create")).select(F.col("prd_source").alias("source_id"), normalized_heading(F.col("prd_section")).alias("key")).where("key <> ''").distinct()
    both = testable.withColumn("t", F.lit(1)).join(covered.withColumn("c", F.lit(1)), ["source_id", "key"], "full_outer")
    out = both.groupBy("source_id").agg(F.count("t").alias("n_testable"), F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("n_covered"), F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.col("key")))).alias("unmatched"))
    out = sections.select("source_id").distinct().join(out, "source_id", "left").fillna(0, ["n_testable", "n_covered"])
    return out.select("source_id", "n_testable", "n_covered", F.round(F.try_divide("n_covered", "n_testable"), 3).alias("coverage_score"), F.coalesce("unmatched", F.array().cast("array<string>")).alias("unmatched"))
