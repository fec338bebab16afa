from pyspark.sql import functions as F

from vellum.operators import documents as D

CHUNKS = "source_id string, chunk_index int, section_heading string, chunk_text string"


def test_documents_within_and_beyond_a_budget(spark):
    rows = [("a", 0, None, "lead"), ("a", 1, "One", "x" * 40), ("a", 2, "", "y" * 40), ("a", 3, "Two", "z" * 400), ("a", 4, "Three", "t"), ("b", 0, "Only", None)]
    sections = D.section_texts(spark.createDataFrame(rows, CHUNKS)).cache()
    assert [(r.no, r.heading) for r in sections.where("source_id = 'a'").orderBy("no").collect()] == [(1, "(no heading)"), (2, "One"), (3, "Two"), (4, "Three")]
    whole = {r.source_id: r for r in D.read_documents(sections, 10_000).collect()}
    one = "### One\n" + "x" * 40 + "\n\n" + "y" * 40
    assert whole["a"].text == D.BREAK.join(["# a\n\nlead", one, "### Two\n" + "z" * 400, "### Three\nt"]) and whole["a"].n_shown == 4 and whole["b"].text == "# b\n\n### Only\n"
    cut = {r.source_id: r for r in D.read_documents(sections, 110).collect()}
    assert cut["a"].n_shown == 2 and cut["a"].text.endswith(D.BREAK + "lead" + D.BREAK + one) and "  3. Two  (~102 tokens)" in cut["a"].text
    asked = spark.createDataFrame([("a", "2. ONE:"), ("a", "none"), ("c", "One")], "source_id string, section string")
    assert {(r.source_id, r.section): r.block for r in D.read_sections(sections, asked).collect()} == {("a", "2. ONE:"): one, ("a", "none"): None, ("c", "One"): None}


def test_judge_contexts(spark):
    rows = [("a", 0, "1. Pay:", "first "), ("a", 1, None, "  "), ("a", 2, "Other", "no"), ("a", 3, "PAY", "w" * 20)]
    needs = D.requirement_texts(spark.createDataFrame(rows, CHUNKS), 15)
    decisions = spark.createDataFrame([(1, "a", "pay", "T-1", "keep", None), (2, "a", None, None, "create", "new"), (3, "a", "Gone", "T-9", "update", "x")], "id int, prd_source string, prd_section string, jira_key string, action string, reason string")
    tests = spark.createDataFrame([("T-1", None, ["a", "b"], "s" * 600)], "jira_key string, summary string, labels array<string>, steps_text string")
    got = {r.id: r.context for r in D.judge_contexts(decisions, needs, tests).collect()}
    assert got[1] == "## Section\npay\n\n## Requirement\nfirst\n\n" + "w" * 8 + "\n\n[…truncated for judge context]\n\n## Test: T-1\nSummary: N/A\nLabels: a, b\nSteps: " + "s" * 500 + "\n\n## Decision: KEEP\n\nReason: No reason given"
    assert got[2].startswith("## Section\nNot specified\n\n## Requirement\n(No text") and "## Test" not in got[2] + got[3] and got[3].endswith("Reason: x")


def test_grades(spark):
    rows = [("a", 4.5, 3.5, 9.0), ("b", 0.4, 2.0, None), ("c", 5.0, 5.0, 5.0), ("d", None, None, None)]
    graded = D.graded(spark.createDataFrame(rows, "decision_id string, correctness double, reasoning double, completeness double")).cache()
    got = {r.decision_id: (r.correctness, r.reasoning, r.completeness, r.rubric_score, r.missing) for r in graded.collect()}
    assert got == {"a": (4, 4, 5, 0.83, ""), "b": (1, 2, None, None, "completeness"), "c": (5, 5, 5, 1.0, ""), "d": (None, None, None, None, "completeness,correctness,reasoning")}
    assert tuple(D.judge_report(graded).first()) == (2, 2, 4.5, 4.5, 5.0, 0.915)
    assert D.judge_report(graded.where(F.lit(False))).first().evaluated == 0
