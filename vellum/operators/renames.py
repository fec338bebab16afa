"""Sections that were renamed: by equal content, then by similar titles, and decisions carried across.

Tables of headings are ``source_id, heading, hash``. Titles are compared by the share of their characters in matching
blocks (longest block first, then left and right of it), on headings in normal form. Only headings that one side lacks
are compared, within their source, and only in sources of at most ``most_pairs`` combinations; ``pairing_limits`` says which
sources are left to rule 1 alone. So no source makes more than ``most_pairs`` rows, whatever its size."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normalized_heading
from vellum.operators.sync import renames

FLOOR, MOST_PAIRS = 0.70, 10_000


def _similarity(floor: float):
    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def ratio(x: str, y: str) -> float:
            m = SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= floor else 0.0  # the quick one bounds it from above

        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return similar


def title_similarity(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Similarity of two texts from 0 to 1; those below ``floor`` may be given as 0."""
    return _similarity(floor)(a, b)


def _unpaired(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings that only one side has and that rule 1 leaves: (gone, come)."""
    exact = renames(old, new)
    keys = ["source_id", "heading"]
    gone = old.join(new.select(*keys), keys, "left_anti").join(exact.select("source_id", F.col("old_heading").alias("heading")), keys, "left_anti")
    come = new.join(old.select(*keys), keys, "left_anti").join(exact.select("source_id", F.col("new_heading").alias("heading")), keys, "left_anti")
    return gone, come


def _sizes(gone: DataFrame, come: DataFrame) -> DataFrame:
    n_gone, n_come = (d.groupBy("source_id").agg(F.count("*").alias(n)) for d, n in ((gone, "n_removed"), (come, "n_added")))
    return n_gone.join(n_come, "source_id")


def pairing_limits(old: DataFrame, new: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``source_id, n_removed, n_added, titles_compared`` of sources that have headings on both sides after rule 1."""
    return _sizes(*_unpaired(old, new)).select("*", (F.col("n_removed") * F.col("n_added") <= most_pairs).alias("titles_compared"))


def rename_map(old: DataFrame, new: DataFrame, floor: float = FLOOR, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``source_id, old_heading, new_heading, rule, score``: every heading on at most one row.

    Rule ``content``: equal hashes, in alphabetical order. Rule ``title``, for the others: the most similar pair first, ties
    by old, then new heading, down to ``floor``."""
    exact = renames(old, new).select("source_id", "old_heading", "new_heading", F.lit("content").alias("rule"), F.lit(1.0).alias("score"))
    gone, come = _unpaired(old, new)
    small = _sizes(gone, come).where(F.col("n_removed") * F.col("n_added") <= most_pairs).select("source_id")
    side = lambda d, h, n: d.join(small, "source_id", "left_semi").select("source_id", F.col("heading").alias(h), normalized_heading(F.col("heading")).alias(n))
    pairs = side(gone, "old_heading", "a").join(side(come, "new_heading", "b"), "source_id")
    la, lb = F.length("a"), F.length("b")
    pairs = pairs.where(2 * F.least(la, lb) >= floor * (la + lb))  # no more characters than these can match
    scored = pairs.withColumn("score", title_similarity(F.col("a"), F.col("b"), floor)).where(F.col("score") >= floor)
    schema = pa.schema([("source_id", pa.string()), ("old_heading", pa.string()), ("new_heading", pa.string()), ("rule", pa.string()), ("score", pa.float64())])

    def take(batches):
        source, olds, news = None, set(), set()
        for batch in batches:
            rows = []
            for s, a, b, score in zip(*(batch.column(c).to_pylist() for c in ("source_id", "old_heading", "new_heading", "score")), strict=True):
                if s != source:
                    source, olds, news = s, set(), set()
                if a not in olds and b not in news:
                    olds.add(a)
                    news.add(b)
                    rows.append((s, a, b, "title", score))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    ordered = scored.select("source_id", "old_heading", "new_heading", "score").repartition("source_id").sortWithinPartitions("source_id", F.desc("score"), "old_heading", "new_heading")
    return exact.unionByName(ordered.mapInArrow(take, "source_id string, old_heading string, new_heading string, rule string, score double"))


def section_changes(old: DataFrame, new: DataFrame, renamed: DataFrame) -> DataFrame:
    """``source_id, heading, status, old_heading``: a renamed section counts under its new heading as changed or unchanged,
    never as one removed and one new."""
    keys = ["source_id", "heading"]
    pairs = renamed.select("source_id", F.col("old_heading").alias("heading"), "new_heading")
    was = old.join(pairs, keys, "left").select("source_id", F.coalesce("new_heading", "heading").alias("heading"), F.col("heading").alias("old_heading"), F.col("hash").alias("a"))
    j = was.join(new.select(*keys, F.col("hash").alias("b")), keys, "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return j.select(*keys, status.alias("status"), F.when(F.col("old_heading") != F.col("heading"), F.col("old_heading")).alias("old_heading"))


def restamped(reason: Column, run_id: Column, most: int = 2000) -> Column:
    """The reason under a stamp of the run it comes from, in place of an earlier stamp."""
    text = F.coalesce(reason, F.lit(""))
    stamped = F.contains(text, F.lit("[Carried forward from")) & F.contains(text, F.lit("] "))
    body = F.when(stamped, F.trim(F.regexp_replace(text, r"(?s)^.*?\] ", ""))).otherwise(text)
    return F.substring(F.trim(F.concat(F.lit("[Carried forward from "), F.substring(run_id, 1, 8), F.lit("] "), body)), 1, most)


def carried_over(previous: DataFrame, existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Previous decisions of sections that did not change (``changes`` as of ``section_changes``), restated under the new
    heading of renamed ones, without those that ``existing`` has for the same test and section; one a test and section.

    Columns of ``previous``, with ``prd_section``, ``reason`` and review state as the new run stores them."""
    norm = normalized_heading
    same = changes.where("status = 'unchanged'")
    keep = same.select("source_id", norm(F.col("heading")).alias("sec"), F.lit(None).cast("string").alias("renamed_to"))
    moved = same.where("old_heading IS NOT NULL").select("source_id", norm(F.col("old_heading")).alias("sec"), F.col("heading").alias("renamed_to"))
    one = Window.partitionBy("source_id", "sec").orderBy(F.col("renamed_to").asc_nulls_last())  # a rename goes before a section of that name
    into = moved.unionByName(keep).where("sec <> ''").withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    j = previous.withColumn("sec", norm(F.col("prd_section"))).join(into.withColumnRenamed("source_id", "prd_source"), ["prd_source", "sec"])
    j = j.withColumn("section", F.coalesce("renamed_to", "prd_section")).withColumn("sec", norm(F.col("section")))
    done = existing.select("prd_source", F.col("jira_key").alias("k"), norm(F.col("prd_section")).alias("s")).distinct().withColumnRenamed("prd_source", "p")
    j = j.join(done, (F.col("prd_source") == F.col("p")) & F.col("jira_key").eqNullSafe(F.col("k")) & (F.col("sec") == F.col("s")), "left_anti")
    first = Window.partitionBy("prd_source", "jira_key", "sec").orderBy("id")
    approved = F.col("reviewed") & F.coalesce("approved", F.lit(False))
    return j.withColumn("r", F.row_number().over(first)).where("r = 1").select(
        *[c for c in previous.columns if c not in ("prd_section", "reason", "approved", "written_back")], F.col("section").alias("prd_section"), restamped(F.col("reason"), F.col("run_id")).alias("reason"),
        F.when(F.col("reviewed"), F.col("approved")).alias("approved"), (approved & F.col("written_back")).alias("written_back"),
    )
