"""Keeping tables in step with their sources: diffs by hash, upserts, heading changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.scratch import written


def metadata_hash(summary: Column, labels: Column, updated: Column) -> Column:
    """Independent of the labels' order."""
    return F.sha2(F.concat_ws("\u0001", F.coalesce(summary, F.lit("")), F.array_join(F.array_sort(labels), "\u0002"), F.coalesce(updated.cast("string"), F.lit(""))), 256)


def with_hash(listing: DataFrame) -> DataFrame:
    return listing.select("jira_key", metadata_hash(F.col("summary"), F.array("label_a", "label_b"), F.col("updated")).alias("metadata_hash"))


def listing_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed and unchanged keys of ``new`` against ``old`` (both ``jira_key, metadata_hash``)."""
    j = new.join(old.withColumnRenamed("metadata_hash", "old_hash"), "jira_key", "left")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("metadata_hash"), "changed").otherwise("unchanged")
    return j.select("jira_key", status.alias("status"))


def stale_keys(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Keys gone from the source; none if it returned less than ``least`` of what was known."""
    counts = old.agg(F.count("*").alias("n_old")).withColumn("one", F.lit(1)).join(new.agg(F.count("*").alias("n_new")).withColumn("one", F.lit(1)), "one")
    enough = counts.where((F.col("n_new") > 0) & (F.col("n_new") >= least * F.col("n_old"))).select("one")  # one row or none
    gone = old.select("jira_key").join(new.select("jira_key"), "jira_key", "left_anti")
    return gone.withColumn("one", F.lit(1)).join(F.broadcast(enough), "one", "left_semi").select("jira_key")


def descendants(pages: DataFrame, root: int, depth: int = 20) -> DataFrame:
    """``id, depth`` of all below ``root`` in ``pages`` (``id, parent``), a join a level, each written, to ``depth`` or the last level that has any."""
    level = written(pages.where(F.col("parent") == root).select("id", F.lit(1).alias("depth")), "level")
    found = level
    for k in range(2, depth + 1):
        level = written(pages.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(k).alias("depth")), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def upsert(old: DataFrame, new: DataFrame, key: str = "jira_key") -> DataFrame:
    """Rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def source_versions(chunks: DataFrame) -> DataFrame:
    """The one version of each source, '' where its chunks disagree."""
    v = F.coalesce("source_version", F.lit(""))
    return chunks.groupBy("source_id").agg(F.when(F.min(v) == F.max(v), F.min(v)).otherwise("").alias("version"))


def to_fetch(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """Whether each live page (``source_id, live_version``) has to be fetched again."""
    j = live.join(indexed, "source_id", "left")
    same = (F.coalesce("version", F.lit("")) != "") & (F.col("version") == F.col("live_version").cast("string"))
    return j.select("source_id", (~same).alias("fetch"))


def inherited(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the heading of each chunk, taken on from the last one that has any."""
    w = Window.partitionBy("source_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("heading", F.last(F.nullif(F.trim("section_heading"), F.lit("")), True).over(w))


def heading_hashes(chunks: DataFrame) -> DataFrame:
    """Hash of the ordered texts under each heading of a source."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    return chunks.groupBy("source_id", F.coalesce("heading", F.lit("(no heading)")).alias("heading")).agg(F.sha2(F.array_join(texts, "|"), 256).alias("hash"))


def heading_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, removed, changed and unchanged headings of each source."""
    j = old.select("source_id", "heading", F.col("hash").alias("a")).join(new.select("source_id", "heading", F.col("hash").alias("b")), ["source_id", "heading"], "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return j.select("source_id", "heading", status.alias("status"))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Headings of equal content under another name, paired one to one in alphabetical order."""
    w = Window.partitionBy("source_id", "hash").orderBy("heading")
    gone = old.join(new.select("source_id", "heading"), ["source_id", "heading"], "left_anti").withColumn("no", F.row_number().over(w))
    come = new.join(old.select("source_id", "heading"), ["source_id", "heading"], "left_anti").withColumn("no", F.row_number().over(w))
    return gone.withColumnRenamed("heading", "old_heading").join(come.withColumnRenamed("heading", "new_heading"), ["source_id", "hash", "no"]).select("source_id", "old_heading", "new_heading")


def budget_prefix(parts: DataFrame, budget: int) -> DataFrame:
    """The leading parts of each source whose running cost fits the budget, up to the first that doesn't."""
    w = Window.partitionBy("source_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("running", F.sum("cost").over(w)).withColumn("over", F.max((F.col("running") > budget).cast("int")).over(w)).where("over = 0").select("source_id", "chunk_index", F.col("running").cast("long").alias("running"))


def section_profile(chunks: DataFrame) -> DataFrame:
    """Words and chunks under each heading, with its first position."""
    words = F.size(F.filter(F.split(F.trim("chunk_text"), r"\s+"), lambda x: x != ""))
    return inherited(chunks).groupBy("source_id", "heading").agg(F.min("chunk_index").cast("long").alias("first"), F.count("*").alias("n_chunks"), F.sum(words).cast("long").alias("n_words"))
