"""Writing chunks, tests and decisions: replacement by source, deletion, merging, enrichment, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import confidence


def replaced_by_source(stored: DataFrame, written: DataFrame, intended: DataFrame, key: str = "source_id") -> DataFrame:
    """The store after new chunks were written. A source's old chunks go only if all that were intended
    (``<key>, n_intended``) were written; where none were, nothing changes, and where some failed, old and new stay."""
    done = written.groupBy(key).agg(F.count("*").alias("n_written"))
    whole = intended.join(done, key).where((F.col("n_written") >= F.col("n_intended")) & (F.col("n_written") > 0)).select(key)
    return stored.join(whole, key, "left_anti").unionByName(written)


def deleted(stored: DataFrame, gone: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(what stays, how many rows of each key in ``gone`` went, zeros included)."""
    keys = gone.select(key).distinct()
    counts = keys.join(stored.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_deleted"))
    return stored.join(keys, key, "left_anti"), counts


def new_decisions(d: DataFrame, now: Column) -> DataFrame:
    """Decisions as they are stored: texts cut to their fields, confidence coerced, a review stamp where reviewed."""
    return d.select(
        "id", F.substring("run_id", 1, 64).alias("run_id"), F.substring(F.coalesce("reason", F.lit("")), 1, 2000).alias("reason"), F.substring("prd_section", 1, 500).alias("prd_section"),
        confidence(F.col("confidence")).alias("confidence"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.when(F.col("reviewed"), now).alias("reviewed_at"),
    )


def merged_maps(old: Column, patch: Column) -> Column:
    """Shallow merge of two maps, the right one winning; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(old, none), F.coalesce(patch, none), lambda _, a, b: F.struct(a.alias("a"), b.alias("b")))
    has = F.coalesce(patch, none)
    return F.transform_values(both, lambda k, v: F.when(F.map_contains_key(has, k), v["b"]).otherwise(v["a"]))


def ancestry_reason(reason: Column) -> Column:
    return F.nullif(F.substring(reason, 1, 500), F.lit(""))


def content_changed(old: DataFrame, new: DataFrame, key: str = "jira_key") -> DataFrame:
    """Tests whose content hash (of details fetched) differs from the stored one; unknown ones are changed."""
    j = new.select(key, F.col("hash").alias("new_hash")).join(old.select(key, F.col("hash").alias("old_hash")), key, "left")
    return j.select(key, (~F.col("new_hash").eqNullSafe(F.col("old_hash"))).alias("changed"))


def enriched(tests: DataFrame, details: DataFrame, key: str = "jira_key") -> DataFrame:
    """Listing rows (``labels``) with description and steps; detail labels override only where there are any."""
    d = details.select(key, F.col("labels").alias("detail_labels"), "description", "steps_text")
    own = F.when(F.size(F.coalesce("detail_labels", F.array().cast("array<string>"))) > 0, F.col("detail_labels")).otherwise(F.col("labels"))
    return tests.join(d, key, "left").select(key, own.alias("labels"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("steps_text", F.lit("")).alias("steps_text"))


def size_stats(chunks: DataFrame, group: str) -> DataFrame:
    """Chunk sizes of each group: least, upper median, greatest, total and how many of each type."""
    sizes = F.array_sort(F.collect_list("size"))
    return chunks.groupBy(group).agg(
        F.count("*").alias("n"), F.min("size").alias("least"), F.get(sizes, F.floor(F.count("*") / 2).cast("int")).alias("median"), F.max("size").alias("most"), F.sum("size").alias("total"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("table", "code", "mixed", "prose")],
    )


def sync_summary(diff: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: rows upserted, unchanged and deleted."""
    counts = diff.agg(F.count_if(F.col("status") != "unchanged").alias("upserted"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))
    gone = stale.agg(F.count("*").alias("deleted"))
    return counts.withColumn("one", F.lit(1)).join(gone.withColumn("one", F.lit(1)), "one").drop("one")  # a row each


def usage_totals(calls: DataFrame, prices: DataFrame, cached: float = 0.1, written: float = 1.25) -> DataFrame:
    """Tokens a run, their price (per million: ``model, in_price, out_price``; null for unknown models), the share of
    input that a cache gave, and whether the totals are a lower bound."""
    t = calls.groupBy("run_id", "model").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
        F.count("*").alias("calls"), F.count("input_tokens").alias("reported"),
    ).join(F.broadcast(prices), "model", "left")  # a row a model
    cost = (F.col("in_price") * (F.col("input_tokens") + cached * F.col("cache_read_tokens") + written * F.col("cache_write_tokens")) + F.col("out_price") * F.col("output_tokens")) / 1_000_000
    billable = F.col("input_tokens") + F.col("cache_read_tokens")
    return t.select("run_id", "model", "input_tokens", "output_tokens", "calls", F.round(cost, 4).alias("cost"), F.round(F.try_divide("cache_read_tokens", billable), 3).alias("cache_hit_ratio"), (F.col("reported") < F.col("calls")).alias("lower_bound"))
