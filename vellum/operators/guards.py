"""Guards and gates on proposed decisions, module filters, steps and questions, as columns or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normalized_heading, reason_problem, tokens
from vellum.operators.review import ACTIONS

TERMINAL = ("completed", "completed_empty", "truncated")
STEP = "array<struct<action:string,data:string,expectedResult:string,result:string>>"
# What counts as an enumerated line and what parts a step from its expected result.
OUTLINE = r"(?i)^\s*(?:\d+\s*[.)\-:]|[-*•]|step\s*\d+\s*[:.)\-])\s*(.+)$"
EXPECTED = r"(?i)\s*(?:->|=>|→|\|\s*expected\s*:|\bexpected\s*:)\s*"


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase's words stand side by side in the text, whatever their case."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return F.contains(padded(text), padded(F.lit(phrase)))


# Phrases by which a title is of a type, and the form of a version at its start.
TITLE_PHRASES = {
    "test_plan": ("test plan", "test case", "test cases", "qa plan", "regression suite"),
    "implementation_plan": ("implementation plan", "impl plan"),
    "tech_doc": ("tech doc", "techdoc", "tech design", "technical design", "technical document", "architecture", "hld", "lld"),
    "release_note": ("release note", "release notes", "changelog", "hotfix"),
    "meeting_note": ("grooming", "meeting notes", "meeting note", "standup", "stand up", "retro", "retrospective", "sync notes", "planning"),
    "prd": ("prd", "prds", "product requirement", "product requirements", "requirement document", "brd", "frd"),
}
VERSION_TITLE = r"^[vV][0-9]+\.[0-9]+"


def titled(title: Column, kind: str) -> Column:
    """Whether a title has a phrase of this type; ``other`` is a title that has none of any."""
    if kind == "other":
        return ~_any(*[titled(title, k) for k in TITLE_PHRASES])
    version = [F.coalesce(title, F.lit("")).rlike(VERSION_TITLE)] if kind == "release_note" else []
    return _any(*[has_phrase(title, p) for p in TITLE_PHRASES[kind]], *version)


def _any(first: Column, *others: Column) -> Column:
    for c in others:
        first = first | c
    return first


def title_filter(title: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Titles of an included type (all, if none is named) and of no excluded one. Unknown types are ignored, and ``other`` is never
    excluded, as a title that says nothing is no evidence."""
    known = (*TITLE_PHRASES, "other")
    wanted, unwanted = [t for t in include if t in known], [t for t in exclude if t in TITLE_PHRASES]
    keep = _any(*[titled(title, t) for t in wanted]) if wanted else F.lit(True)
    return keep & ~_any(*[titled(title, t) for t in unwanted]) if unwanted else keep


def normalized_modules(modules: Column) -> Column:
    """Trimmed, without blanks, the first spelling of each name, sorted; null if nothing is left."""
    named = F.filter(F.transform(modules, lambda m: F.trim(m)), lambda m: m != "")
    lowered = F.transform(named, F.lower)
    first = F.filter(named, lambda m, k: F.array_position(lowered, F.lower(m)) == k + 1)
    return F.when(F.size(first) > 0, F.array_sort(first))


def module_problem(requested: Column, available: Column) -> Column:
    """A filter of which no module is known is a mistake, unless nothing is known at all."""
    asked = F.size(F.coalesce(requested, F.array().cast("array<string>"))) > 0
    known = F.size(F.coalesce(available, F.array().cast("array<string>"))) > 0
    return F.when(asked & known & ~F.arrays_overlap(requested, available), "module_not_found")


def module_problems(requests: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``module_problem`` of each request (``<key>, requested``) against the modules that ``index`` holds, met by a join."""
    known = index.select(F.col("module").alias("m")).where("m IS NOT NULL").distinct()
    asked = requests.where(F.size("requested") > 0).select(key, F.explode("requested").alias("m"))
    fine = asked.join(known, "m", "left_semi").select(key).distinct().withColumn("fine", F.lit(True))
    any_known = known.limit(1).select(F.lit(True).alias("any_known"))
    rows = requests.select(key, (F.size("requested") > 0).alias("asks"), F.lit(True).alias("any_known")).join(fine, key, "left").join(F.broadcast(any_known), "any_known", "left_semi")
    bad = rows.where("asks AND fine IS NULL").select(key, F.lit("module_not_found").alias("problem"))
    return requests.select(key).join(bad, key, "left")


def in_focus(chunks: DataFrame, focus: DataFrame) -> DataFrame:
    """Chunks (with ``heading``, inherited) whose heading is in ``focus`` (``focus_heading``), as written or normalized."""
    wanted = focus.select(F.col("focus_heading").alias("f")).union(focus.select(normalized_heading(F.col("focus_heading")))).distinct()
    either = F.array_distinct(F.array(F.coalesce("heading", F.lit("")), normalized_heading(F.col("heading"))))
    key = chunks.select("source_id", "chunk_index", F.explode(either).alias("f"))
    hit = key.join(wanted.where("f <> ''"), "f", "left_semi").select("source_id", "chunk_index").distinct()
    return chunks.join(hit, ["source_id", "chunk_index"], "left_semi")


def banded(score: Column, high: float, medium: float) -> Column:
    """high, medium or null (to be dropped)."""
    return F.when(score >= high, "high").when(score >= medium, "medium")


def banded_row(rerank_score: Column, rrf: Column, has_steps: Column) -> Column:
    """Band of a search result: by the reranker's score (2.0 and 0.5) where there is one and the row has steps, else by the fused
    score (0.025 and 0.012)."""
    return F.when(rerank_score.isNotNull() & F.coalesce(has_steps, F.lit(False)), banded(rerank_score, 2.0, 0.5)).otherwise(banded(rrf, 0.025, 0.012))


def decision_problem(p: DataFrame, seen: DataFrame) -> DataFrame:
    """``p`` with ``problem``: the first rule that a proposed decision breaks, or null. ``seen`` has the ``jira_key`` of
    tests that were retrieved."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = p.join(seen.select(F.col("jira_key").alias("seen_key")).distinct(), p["jira_key"] == F.col("seen_key"), "left")
    broken = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action")
        .when(reason_problem(F.col("action"), F.col("reason")).isNotNull(), reason_problem(F.col("action"), F.col("reason")))
        .when(F.col("action").isin("keep", "update", "deprecate") & ~has("jira_key"), "key_missing")
        .when((F.col("action") == "update") & (F.trim(F.coalesce("suggested_changes", F.lit(""))) == ""), "changes_missing")
        .when((F.col("action") == "create") & ~has("new_summary"), "summary_missing")
        .when((F.col("action") == "create") & has("jira_key"), "key_not_allowed")
        .when(has("jira_key") & F.col("seen_key").isNull(), "key_not_retrieved")
    )
    return rows.withColumn("problem", broken).drop("seen_key")


def advised_once(attempts: DataFrame) -> DataFrame:
    """Attempts (``guard, identity, attempt_no, verdict``) with ``outcome``: a blocked one is refused always, a warned one
    the first time only, others pass."""
    w = Window.partitionBy("guard", "identity").orderBy("attempt_no")
    earlier = F.coalesce(F.count_if(F.col("verdict") == "warn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(F.col("verdict") == "block", "refused").when((F.col("verdict") == "warn") & (earlier == 0), "advised").otherwise("passes")
    return attempts.withColumn("outcome", outcome)


def valid_steps(steps: Column) -> Column:
    """JSON list to numbered steps; null unless it is a non-empty list in which every item has an action."""
    parsed = F.from_json(steps, STEP)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    expected = lambda s: text(F.coalesce(F.nullif(s["expectedResult"], F.lit("")), s["result"]))
    good = (F.size(parsed) > 0) & F.forall(parsed, lambda s: text(s["action"]) != "")
    numbered = F.transform(parsed, lambda s, k: F.struct(text(s["action"]).alias("action"), text(s["data"]).alias("data"), expected(s).alias("expected"), (k + 1).alias("index")))
    return F.when(good, numbered)


def outline_steps(text: Column) -> Column:
    """Steps of an enumerated outline, ``action`` and ``expected``; null if no line is enumerated."""
    bodies = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(OUTLINE)), lambda x: F.trim(F.regexp_extract(x, OUTLINE, 1)))
    parts = F.transform(F.filter(bodies, lambda b: b != ""), lambda b: F.split(b, EXPECTED, 2))
    steps = F.transform(parts, lambda p: F.struct(F.trim(F.get(p, 0)).alias("action"), F.trim(F.coalesce(F.get(p, 1), F.lit(""))).alias("expected")))
    return F.when(F.size(steps) > 0, steps)


def question_context(source: Column, section: Column, run: Column) -> Column:
    """Where a question came from; parts that are null or empty are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" | ", part("PRD", source), part("Section", section), part("Run", run))


def webhook_action(previous: Column, analyze: bool, analyze_new: bool, free_slots: Column) -> Column:
    """What a change of a page leads to, by whether it was analysed before."""
    seen = previous.isNotNull()
    wants = (seen & F.lit(analyze)) | (~seen & F.lit(analyze_new))
    return (
        F.when(wants & (free_slots == 0), "skipped_at_capacity").when(seen & F.lit(analyze), "incremental").when(~seen & F.lit(analyze_new), "full")
        .when(~seen, "skipped_never_analysed").otherwise("skipped_disabled")
    )


def repeats_finished_run(status: Column) -> Column:
    """A run of the same identity that has ended well is returned, not started again."""
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def triage_turn(turns: Column, ahead: int = 10) -> Column:
    """The turn to warn at: ``ahead`` before the last, in short runs after seven tenths; none in runs of up to two."""
    return F.when(turns > F.greatest(F.lit(ahead), F.lit(2)), turns - ahead).when(turns > 2, F.greatest(F.lit(1), F.floor(turns * 0.7).cast("int")))
