"""Write-back of approved decisions to the test library, with label snapshots and rollback.

``plan`` says what each decision does, ``applied`` the library and the decisions after it; both are functions of tables, so a run that
dies can be done again. A deprecation keeps the labels it is about to change; ``rolled_back`` puts them back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.guards import outline_steps, valid_steps
from vellum.operators.review import ACTIONS

BATCH, SAMPLE, DEPRECATED = 50, 500, "DEPRECATED"
CONTENT = ("summary", "steps_json", "suggested_changes", "suggested_steps", "created_jira_key")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def plan(decisions: DataFrame, tests: DataFrame, project: str | None = "PROJ") -> DataFrame:
    """``decisions`` that are approved and not written back, with ``op`` (none, comment, update, deprecate, create, adopt: created
    before), ``error`` (nothing is done), ``note`` (done, but), ``pre_labels`` and, for creations, ``batch`` and ``position``.

    Decisions have ``id, run_id, jira_key, action, reason`` and, as content, ``summary, steps_json, suggested_changes, suggested_steps,
    created_jira_key``. ``tests`` are ``jira_key, summary, labels, steps``. Creations go in batches of 50 a run, by id."""
    ready = decisions.where("reviewed AND approved AND NOT written_back")
    labels = tests.select(F.col("jira_key").alias("test_key"), F.col("labels").alias("own_labels"))
    j = ready.join(labels, F.col("jira_key") == F.col("test_key"), "left")
    action, no_key = F.col("action"), _blank("jira_key")
    steps = valid_steps(F.col("steps_json"))
    raw = ~F.coalesce(F.col("steps_json").isNull() | F.col("steps_json").isin("", "[]", "null"), F.lit(False))
    error = (
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown_action").when(action.isin("update", "deprecate") & no_key, "key_missing")
        .when((action == "update") & raw & steps.isNull(), "steps_invalid")
        .when((action == "update") & _blank("summary") & steps.isNull() & _blank("suggested_changes"), "payload_missing")
        .when((action == "create") & _blank("created_jira_key") & F.lit(not project), "project_missing")
    )
    op = (
        F.when(error.isNotNull(), "none").when((action == "keep") | ((action == "question") & no_key), "none").when(action == "question", "comment")
        .when((action == "create") & ~_blank("created_jira_key"), "adopt").otherwise(action)
    )
    out = j.withColumns({"op": op, "error": error, "valid_steps": steps})
    out = out.withColumns({"note": F.when((F.col("op") == "deprecate") & F.col("test_key").isNull(), "no_snapshot"), "pre_labels": F.when(F.col("op") == "deprecate", F.col("own_labels"))})
    nth = F.row_number().over(Window.partitionBy("run_id", "op").orderBy("id")) - 1
    place = lambda c: F.when(F.col("op") == "create", c.cast("int"))
    return out.withColumns({"batch": place(F.floor(nth / BATCH)), "position": place(nth % BATCH)}).drop("test_key", "own_labels")


def new_tests(planned: DataFrame) -> DataFrame:
    """What each creation asks for: ``id, run_id, batch, position, summary, steps, description``. Steps come from valid ones, else from an
    enumerated outline; an outline in prose is the description."""
    outline = outline_steps(F.col("suggested_steps"))
    steps = F.coalesce(F.transform("valid_steps", lambda s: F.struct(s["action"].alias("action"), s["expected"].alias("expected"))), outline)
    prose = F.when(steps.isNull() & ~_blank("suggested_steps"), F.trim("suggested_steps"))
    summary = F.when(_blank("summary"), "New test case").otherwise(F.col("summary"))
    return planned.where("op = 'create'").select("id", "run_id", "batch", "position", summary.alias("summary"), steps.alias("steps"), prose.alias("description"))


def outcomes(planned: DataFrame, created: DataFrame) -> DataFrame:
    """``planned`` with ``created_key`` and ``done``: keys come back by run, batch and position (``run_id, batch, position, key``);
    a creation without one is an error and stays open."""
    keys = created.select("run_id", "batch", "position", F.col("key").alias("created_key"))
    j = planned.join(keys, ["run_id", "batch", "position"], "left")
    error = F.coalesce("error", F.when((F.col("op") == "create") & F.col("created_key").isNull(), "no_key_returned"))
    return j.withColumns({"error": error, "done": error.isNull()})


def applied(results: DataFrame, tests: DataFrame) -> DataFrame:
    """The library after the write-back. Several decisions on one test work in the order of their ids: the last summary and steps
    stay, and ``DEPRECATED`` is added once."""
    by_id = lambda c, cond: F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col("id")))
    update = F.col("op") == "update"
    change = results.where("done AND op IN ('update', 'deprecate')").groupBy("jira_key").agg(
        by_id("summary", update & ~_blank("summary")).alias("new_summary"), by_id("valid_steps", update & F.col("valid_steps").isNotNull()).alias("new_steps"),
        F.max(F.col("op") == "deprecate").alias("gone"),
    )
    have = F.coalesce("labels", F.array().cast("array<string>"))
    labels = F.when(F.coalesce("gone", F.lit(False)) & ~F.array_contains(have, DEPRECATED), F.concat(have, F.array(F.lit(DEPRECATED)))).otherwise(F.col("labels"))
    steps = F.coalesce(F.transform("new_steps", lambda s: F.struct(s["action"].alias("action"), s["expected"].alias("expected"))), F.col("steps"))
    old = tests.join(change, "jira_key", "left").select("jira_key", F.coalesce(F.trim("new_summary"), "summary").alias("summary"), labels.alias("labels"), steps.alias("steps"))
    keys = results.where("op = 'create' AND done").select("id", "created_key")
    new = new_tests(results).join(keys, "id").select(F.col("created_key").alias("jira_key"), "summary", F.array().cast("array<string>").alias("labels"), "steps")
    return old.unionByName(new)


def counts(results: DataFrame) -> DataFrame:
    """Decisions of each action that were written, that failed, and that were written with a note."""
    return results.groupBy("action").agg(F.count_if("done").alias("written"), F.count_if(~F.col("done")).alias("failed"), F.count_if(F.col("done") & F.col("note").isNotNull()).alias("noted"))


def dry_run(planned: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """What a run would do: (counts by action and op, the first ``sample`` rows)."""
    return planned.groupBy("action", "op", "error").agg(F.count("*").alias("n")), planned.orderBy("id").limit(min(SAMPLE, sample)).select("id", "run_id", "jira_key", "action", "op", "error")


def rollback_plan(written: DataFrame) -> DataFrame:
    """``id, jira_key, problem, restore``: why a decision can't be rolled back, or the labels it would restore. ``written`` are decisions
    with ``written_back`` and ``pre_labels`` as the write-back left them."""
    problem = (
        F.when(~(F.col("action") == "deprecate"), "not_a_deprecation").when(~F.col("written_back"), "not_written_back")
        .when(F.col("pre_labels").isNull(), "no_snapshot").when(_blank("jira_key"), "key_missing")
    )
    return written.select("id", "jira_key", problem.alias("problem"), F.when(problem.isNull(), F.col("pre_labels")).alias("restore"))


def rolled_back(tests: DataFrame, rollback: DataFrame) -> DataFrame:
    """The library with the labels of eligible rollbacks put back outright; of several for one test the earliest snapshot."""
    back = rollback.where("problem IS NULL").groupBy("jira_key").agg(F.min_by("restore", "id").alias("restore"))
    return tests.join(back, "jira_key", "left").withColumn("labels", F.coalesce("restore", "labels")).drop("restore")


def ancestry(results: DataFrame, rollback: DataFrame | None = None) -> DataFrame:
    """``jira_key, run_id, decision_id, change_type, reason``: a row a change made, rollbacks included."""
    kind = F.when(F.col("op") == "update", "updated").when(F.col("op") == "deprecate", "deprecated").when(F.col("op") == "create", "created")
    key = F.when(F.col("op") == "create", F.col("created_key")).otherwise(F.col("jira_key"))
    rows = results.where("done AND op IN ('update', 'deprecate', 'create')").select(key.alias("jira_key"), "run_id", F.col("id").alias("decision_id"), kind.alias("change_type"), F.nullif(F.substring("reason", 1, 500), F.lit("")).alias("reason"))
    if rollback is not None:
        back = rollback.where("problem IS NULL").join(results.select("id", "run_id"), "id")
        rows = rows.unionByName(back.select("jira_key", "run_id", F.col("id").alias("decision_id"), F.lit("rolled_back").alias("change_type"), F.lit("Labels restored from the snapshot.").alias("reason")))
    return rows
