"""Documents as an analysis reads them: sections rendered within a budget, single sections, and what a judge sees of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normalized_heading, sanitized, token_count
from vellum.operators.sync import inherited

BREAK, NONE, JUDGED, STEPS = "\n\n---\n\n", "(no heading)", 12_000, 500


def section_texts(chunks: DataFrame) -> DataFrame:
    """``source_id, no, heading, block, tokens``: each document's headings in their order, with the (sanitized) texts under them
    as they are shown. Chunks without a heading belong to the last one."""
    rows = inherited(chunks).withColumn("heading", F.coalesce(sanitized(F.col("heading")), F.lit(NONE)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", sanitized(F.coalesce("chunk_text", F.lit(""))).alias("t")))), lambda x: x["t"])
    out = rows.groupBy("source_id", "heading").agg(F.min("chunk_index").alias("first"), F.array_join(parts, "\n\n").alias("body"))
    block = F.when(F.col("heading") == NONE, F.col("body")).otherwise(F.concat(F.lit("### "), "heading", F.lit("\n"), "body"))
    no = F.row_number().over(Window.partitionBy("source_id").orderBy("first", "heading"))
    return out.select("source_id", no.alias("no"), "heading", block.alias("block")).withColumn("tokens", token_count(F.col("block")))


def read_documents(sections: DataFrame, budget: int, title: Column | None = None) -> DataFrame:
    """``source_id, n_sections, n_shown, text``: the whole document if it has at most ``budget`` tokens, else an outline of all sections
    with their sizes and as many opening sections as the rest of the budget holds."""
    title = F.col("source_id") if title is None else title
    listed = sections.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("no", "heading", "block", "tokens"))).alias("s"))
    blocks = F.transform("s", lambda x: x["block"])
    full = F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(blocks, BREAK))
    rows = listed.withColumn("full", full).withColumn("size", token_count(F.col("full")))
    line = lambda x: F.concat(F.lit("  "), x["no"].cast("string"), F.lit(". "), x["heading"], F.lit("  (~"), F.format_number(x["tokens"], 0), F.lit(" tokens)"))
    header = F.concat(
        F.lit("# "), title, F.lit("\n\nThis document is too large to show in full (~"), F.format_number("size", 0), F.lit(f" tokens, budget {budget:,}).\nOutline of all "), F.size("s").cast("string"),
        F.lit(" sections:\n"), F.array_join(F.transform("s", line), "\n"), F.lit(BREAK),
    )
    rows = rows.withColumn("header", header).withColumn("left", F.lit(budget) - token_count(F.col("header")))
    running = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")), lambda a, x: F.when(a["used"] + x["tokens"] <= F.col("left"), F.struct((a["used"] + x["tokens"]).alias("used"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1 << 60).cast("long").alias("used"), a["n"].alias("n"))))
    fits = F.col("size") <= budget
    rows = rows.withColumn("n_shown", F.when(fits, F.size("s")).otherwise(running["n"]))
    shown = F.array_join(F.slice(blocks, F.lit(1), F.col("n_shown")), BREAK)
    return rows.select("source_id", F.size("s").alias("n_sections"), "n_shown", F.when(fits, F.col("full")).otherwise(F.concat("header", shown)).alias("text"))


def read_sections(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``source_id, section``) with ``block``: the first section of this heading, in normal form; null if there is none."""
    first = Window.partitionBy("source_id", "key").orderBy("no")
    known = sections.withColumn("key", normalized_heading(F.col("heading"))).withColumn("r", F.row_number().over(first)).where("r = 1").select("source_id", "key", "block")
    return requests.withColumn("key", normalized_heading(F.col("section"))).join(known, ["source_id", "key"], "left").drop("key")


def requirement_texts(chunks: DataFrame, most: int = JUDGED) -> DataFrame:
    """``source_id, key, requirement``: what each document says under each heading in normal form, in order, cut after ``most`` characters."""
    rows = inherited(chunks).select("source_id", normalized_heading(F.col("heading")).alias("key"), "chunk_index", F.trim(F.coalesce("chunk_text", F.lit(""))).alias("t")).where("key <> '' AND t <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "t"))), lambda x: x["t"])
    out = rows.groupBy("source_id", "key").agg(F.array_join(parts, "\n\n").alias("b"))
    cut = F.when(F.length("b") > most, F.concat(F.substring("b", 1, most), F.lit("\n\n[…truncated for judge context]"))).otherwise(F.col("b"))
    return out.select("source_id", "key", cut.alias("requirement"))


def judge_contexts(decisions: DataFrame, requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """``id, context``: the section's requirement, the test and the decision, as a judge reads them."""
    j = decisions.withColumn("key", normalized_heading(F.col("prd_section"))).join(requirements.withColumnRenamed("source_id", "prd_source"), ["prd_source", "key"], "left")
    card = tests.select("jira_key", F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit("N/A")), F.lit("\nLabels: "), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ", "), F.lit("\nSteps: "), F.substring(F.coalesce(F.nullif("steps_text", F.lit("")), F.lit("N/A")), 1, STEPS)).alias("card"))
    j = j.join(card, "jira_key", "left")
    text = F.coalesce(F.concat(F.lit("## Requirement\n"), "requirement"), F.lit("## Requirement\n(No text of this section is indexed: judge by heading and test.)"))
    parts = [
        F.concat(F.lit("## Section\n"), F.coalesce(F.nullif("prd_section", F.lit("")), F.lit("Not specified"))), text, F.when(F.col("card").isNotNull(), F.concat(F.lit("## Test: "), "jira_key", F.lit("\n"), "card")),
        F.concat(F.lit("## Decision: "), F.upper("action")), F.concat(F.lit("Reason: "), F.coalesce(F.nullif("reason", F.lit("")), F.lit("No reason given"))),
    ]
    return j.select("id", F.concat_ws("\n\n", *parts).alias("context"))


def _dimension(value: Column) -> Column:
    """A grade as 1 to 5, halves rounded to even; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.bround(value.cast("double"), 0).cast("int"), F.lit(5))))


def graded(grades: DataFrame) -> DataFrame:
    """``grades`` (``decision_id, correctness, reasoning, completeness``) coerced, with ``rubric_score`` from 0 to 1 (3 digits, null unless
    all three are there) and the missing ones."""
    names = ("completeness", "correctness", "reasoning")
    out = grades.select("decision_id", *[_dimension(F.col(c)).alias(c) for c in names])
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in names]), lambda x: x.isNotNull()), ",")
    score = (F.col("correctness") * 0.60 + F.col("reasoning") * 0.25 + F.col("completeness") * 0.15) / 5
    return out.select("*", F.bround(score, 3).alias("rubric_score"), missing.alias("missing"))


def judge_report(rows: DataFrame) -> DataFrame:
    """One row over ``graded`` rows: how many are complete or not, and averages over the complete ones."""
    whole = F.col("rubric_score").isNotNull()
    mean = lambda c, digits: F.round(F.avg(F.when(whole, F.col(c))), digits)
    return rows.agg(F.count_if(whole).alias("evaluated"), F.count_if(~whole).alias("incomplete"), *[mean(c, 2).alias(f"avg_{c}") for c in ("correctness", "reasoning", "completeness")], mean("rubric_score", 3).alias("avg_rubric_score"))
