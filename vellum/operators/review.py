"""Decisions: counts, paging, approval, deadlines, lifecycle and write-back, as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normalized_heading

ACTIONS = ("keep", "update", "deprecate", "create", "question")
NEVER_AUTO = ("deprecate", "create")


def action_counts(decisions: DataFrame) -> DataFrame:
    """Decisions a run and action, zeros included."""
    n = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    wide = decisions.groupBy("run_id").agg(*n)
    return wide.select("run_id", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("n")) for a in ACTIONS])).alias("x")).select("run_id", "x.*")


def page(decisions: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page by (created_at, id); limits are clamped to 1..500 and 0 upwards."""
    return decisions.orderBy("created_at", "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def keyset_batches(decisions: DataFrame, size: int) -> DataFrame:
    """Batch number of every decision ready to be written back, by id within its run."""
    ready = decisions.where("reviewed AND approved AND NOT written_back")
    w = Window.partitionBy("run_id").orderBy("id")
    return ready.select("id", "run_id", F.floor((F.row_number().over(w) - 1) / min(500, max(1, size))).cast("long").alias("batch_no"))


def approval_rates(decisions: DataFrame, min_samples: int) -> DataFrame:
    rate = F.when(F.count_if("reviewed") >= min_samples, F.try_divide(F.count_if(F.col("reviewed") & F.col("approved")), F.count_if("reviewed"))).otherwise(0.0)
    return decisions.groupBy("action").agg(F.count_if("reviewed").alias("samples"), F.round(rate, 6).alias("approval_rate"))


def auto_approval(decisions: DataFrame, threshold: float, min_samples: int) -> DataFrame:
    """Why each open decision may not be approved unseen, or null if it may."""
    rates = F.broadcast(approval_rates(decisions, 1))  # one row an action
    open_ = decisions.where("NOT reviewed").join(rates, "action", "left")
    reason = (
        F.when(F.col("action").isin(*NEVER_AUTO), "needs_human")
        .when(~F.col("confidence").eqNullSafe("high"), "low_confidence")
        .when(F.coalesce("samples", F.lit(0)) < min_samples, "few_samples")
        .when(F.coalesce("approval_rate", F.lit(0.0)) < threshold, "low_rate")
    )
    return open_.select("id", "action", reason.alias("reason"))


def overdue(decisions: DataFrame, as_of: Column, days: int) -> DataFrame:
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("created_at")) / 86400
    return decisions.where(~F.col("reviewed") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days)))).select("id", "action", "run_id", F.round(age, 3).alias("age_days"))


def archived(decisions: DataFrame, as_of: Column, days: int, batch: int) -> tuple[DataFrame, DataFrame]:
    """(moved, left): the oldest written-back decisions past their retention, at most ``batch``."""
    due = decisions.where(F.col("written_back") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days)))).orderBy("created_at", "id").limit(batch)
    return due, decisions.join(due.select("id"), "id", "left_anti")


def reviewed(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (``id, approve``) applied to open decisions; reviewed ones stay as they are."""
    j = decisions.join(verdicts, "id", "left")
    takes = ~F.col("reviewed") & F.col("approve").isNotNull()
    return j.withColumns({"approved": F.when(takes, F.col("approve")).otherwise(F.col("approved")), "reviewed": F.col("reviewed") | takes}).drop("approve")


def run_transitions(runs: DataFrame) -> DataFrame:
    """The state of each run after a restart: running ones have failed, empty ones are marked."""
    after = F.when(F.col("status") == "running", "failed").when((F.col("status") == "completed") & (F.col("decisions_made") == 0), "completed_empty").otherwise(F.col("status"))
    return runs.select("run_id", "status", after.alias("status_after"))


def last_analysis(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("prd_source").orderBy(F.desc_nulls_last("completed_at"), F.desc("run_no"))
    return runs.where("run_type = 'analysis'").withColumn("r", F.row_number().over(w)).where("r = 1").select("prd_source", "run_id", "status")


def coverage(decisions: DataFrame) -> DataFrame:
    """Per source and section: how decisions fell and the gap that this leaves."""
    c = lambda cond: F.count_if(cond)
    out = decisions.groupBy("prd_source", "prd_section").agg(
        F.count("*").alias("decisions"), *[c(F.col("action") == a).alias(f"{a}_count") for a in ACTIONS], c(F.col("approved")).alias("approved_count"),
        c(~F.col("reviewed")).alias("pending_count"), c(F.col("written_back")).alias("written_count"), *[c(F.col("confidence") == x).alias(f"{x}_count") for x in ("high", "medium", "low")],
    )
    risk = (
        F.when((F.col("keep_count") > 0) | (F.col("update_count") > 0), "covered").when(F.col("create_count") > 0, "unverified")
        .when(F.col("deprecate_count") > 0, "shrinking").when(F.col("question_count") > 0, "questioned").otherwise("uncovered")
    )
    return out.withColumn("gap_risk", risk)


def writeback_plan(decisions: DataFrame) -> DataFrame:
    """What to do for every decision that is approved and not written back."""
    ready = decisions.where("reviewed AND approved AND NOT written_back")
    known = F.col("jira_key").rlike(r"^[A-Z][A-Z0-9_]*-\d+$")
    op = F.when(F.col("action") == "keep", "none").when(F.col("action") == "question", "comment").when(F.col("action") == "create", "bulk_create").otherwise(F.col("action"))
    error = F.when(F.col("action").isin("update", "deprecate", "question") & ~known, "bad_key")
    w = Window.partitionBy("run_id", "action").orderBy("id")
    batch = F.when(F.col("action") == "create", F.floor((F.row_number().over(w) - 1) / 50).cast("long"))
    return ready.select("id", "run_id", op.alias("op"), error.alias("error"), batch.alias("create_batch"))


def first_of_identity(decisions: DataFrame) -> DataFrame:
    """Numbers a run's decisions of one identity: the same test and (normalized) section, or for new tests the same
    section and summary."""
    new = F.col("action") == "create"
    summary = F.when(new, F.substring(F.trim(F.coalesce("new_summary", F.lit(""))), 1, 400))
    key = F.when(~new, F.trim(F.coalesce("jira_key", F.lit(""))))
    w = Window.partitionBy("run_id", new, key, normalized_heading(F.col("prd_section")), summary).orderBy("id")
    return decisions.withColumn("attempt", F.row_number().over(w).cast("long"))


def carried(previous: DataFrame, unchanged: DataFrame, existing: DataFrame) -> DataFrame:
    """Previous decisions on unchanged sections that the new run has not made again, once an identity."""
    w = Window.partitionBy("jira_key", "prd_section").orderBy("id")
    kept = previous.join(unchanged, "prd_section", "left_semi").join(existing.select("jira_key", "prd_section"), ["jira_key", "prd_section"], "left_anti")
    return kept.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rubric(grades: DataFrame) -> DataFrame:
    """Weighted score of grades clamped to 1..5; null where one is missing."""
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.col(c), F.lit(5)))
    full = F.col("correctness").isNotNull() & F.col("reasoning").isNotNull() & F.col("completeness").isNotNull()
    score = 0.60 * clamp("correctness") + 0.25 * clamp("reasoning") + 0.15 * clamp("completeness")
    return grades.select("decision_id", F.when(full, F.round(score.cast("double"), 4)).alias("rubric"))


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG at ``k`` a query (``query, rank, relevant``)."""
    top = F.col("rank") <= k
    gain = F.when(top & (F.col("relevant") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    out = ranked.groupBy("query").agg(
        F.sum("relevant").alias("r"), F.count_if(top & (F.col("relevant") == 1)).alias("hits"), F.count_if(top).alias("seen"),
        F.max(F.when(F.col("relevant") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(gain).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("r"), F.lit(k)).cast("int"))), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1.0))
    return out.select(
        "query", F.round(F.when(F.col("r") > 0, F.col("hits") / F.col("r")).otherwise(1.0), 6).alias("recall"), F.round(F.try_divide("hits", "seen"), 6).alias("precision"),
        F.round("rr", 6).alias("mrr"), F.round(F.when(F.col("r") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def keyset_page(rows: DataFrame, after: int | str | None, size: int, key: str = "id") -> DataFrame:
    """The next page of ``rows`` by a unique key: those after the last key seen (none at first). The condition reaches the scan
    and only ``size`` rows (1 to 500) a task are kept, whatever came before."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(min(500, max(1, size)))


def keyset_pages(read, size: int, after: int | str | None = None, key: str = "id"):
    """Pages as lists of rows, from the token ``after`` on; ``read()`` gives the rows as they are now. Each page comes with the token
    that resumes behind it, so a reader that stops loses and repeats nothing, though rows are added meanwhile."""
    while page := keyset_page(read(), after, size, key).collect():  # at most 500 rows
        after = page[-1][key]
        yield page, after


def histogram_summaries(values: DataFrame, group: str, value: str) -> DataFrame:
    """Count, sum, extremes and upper quantiles of each group: ``sorted[min(n // 2, n - 1)]`` as the median and, from 20 values on,
    ``sorted[min(floor(0.95 n), n - 1)]``, else the greatest, as the 95th.

    Equal values are counted first (partial sums), and ranks are running sums over the distinct values, so a group is as long as it has
    different values, not as it has rows."""
    counted = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    by_value = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("times").over(by_value), "n": F.sum("times").over(Window.partitionBy(group))})
    at = lambda index: F.min(F.when(F.col("upto") > F.least(index.cast("long"), F.col("n") - 1), F.col(value)))
    out = ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.sum(F.col(value) * F.col("times")).cast("long").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
        at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95_"),
    )
    return out.select(group, "n", "total", "low", "high", "p50", F.when(F.col("n") >= 20, F.col("p95_")).otherwise(F.col("high")).alias("p95"))


def reservoir(events: DataFrame, series: str, order: list[str], most: int = 10_000, keep: int = 5_000) -> DataFrame:
    """Rows of each series, only the last ``keep`` by ``order`` of those with over ``most``. Counts come from partial sums and are met by
    broadcast-size tables or a shuffle; only rows of long series are ranked, and each task keeps its own last ``keep`` of them."""
    n = events.groupBy(series).agg(F.count("*").alias("n_"))
    short = events.join(n.where(F.col("n_") <= most).select(series), series, "left_semi")
    w = Window.partitionBy(series).orderBy(*[F.desc(c) for c in order])
    long = events.join(n.where(F.col("n_") > most).select(series), series, "left_semi").withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= keep).drop("r_")
    return short.unionByName(long)


def final_status(truncated: Column, decisions: Column) -> Column:
    """How an analysis run ends: truncated before empty before completed."""
    return F.when(truncated, "truncated").when(decisions == 0, "completed_empty").otherwise("completed")


def run_lifecycle(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """``run_id, status, changed`` after one request a run (``run_id, request, to``): ``start`` a new run or one that failed, never one that
    runs or ended; ``complete`` (with a terminal status in ``to``, else completed) and ``fail`` a running one; ``reopen`` a failed or
    truncated one. Requests on unknown runs do nothing but start."""
    j = runs.select("run_id", "status").join(requests, "run_id", "full_outer")
    now, ask = F.col("status"), F.col("request")
    ends = F.when(F.col("to").isin("completed", "completed_empty", "truncated"), F.col("to")).otherwise("completed")
    after = (
        F.when((ask == "start") & (now.isNull() | (now == "failed")), "running").when((ask == "complete") & (now == "running"), ends)
        .when((ask == "fail") & (now == "running"), "failed").when((ask == "reopen") & now.isin("failed", "truncated"), "running")
    )
    return j.select("run_id", F.coalesce(after, now).alias("status"), after.isNotNull().alias("changed")).where("status IS NOT NULL")


def page_with_total(decisions: DataFrame, limit: int, offset: int) -> DataFrame:
    """``page`` with the number of all rows on each."""
    total = decisions.agg(F.count("*").alias("total")).withColumn("one_", F.lit(1))  # one row
    return page(decisions, limit, offset).withColumn("one_", F.lit(1)).join(F.broadcast(total), "one_").drop("one_")


def gate(metrics: DataFrame, recall: float = 0.60, mrr: float = 0.40, ndcg: float = 0.40) -> DataFrame:
    """Macro averages (4 digits) of ``retrieval_metrics`` against their thresholds, and the measures that fail."""
    mean = metrics.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])
    low = {"recall": recall, "mrr": mrr, "ndcg": ndcg}
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(c) >= x, F.lit(False)), c) for c, x in low.items()]), lambda x: x.isNotNull())
    return mean.select("*", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passes"))
