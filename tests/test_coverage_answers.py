from pyspark.sql import functions as F

from vellum.operators import answers, coverage, guards, review, search


def test_sections_and_their_coverage(spark):
    chunks = spark.createDataFrame(
        [("d", 0, None, "before any heading", None), ("d", 1, "2. Login:", "one two", "prose"), ("d", 2, " ", "| a |", "table"), ("d", 3, "Appendix", "x", "prose"), ("d", 4, "Cart", "", "prose"), ("d", 5, "2. Login:", "more", "prose"), ("e", 0, "Glossary", "y", None)],
        "source_id string, chunk_index int, section_heading string, chunk_text string, chunk_type string",
    )
    sections = coverage.section_list(chunks).cache()
    assert sorted(tuple(r) for r in sections.collect()) == [
        ("d", 1, "(no heading)", 3, "?", True), ("d", 2, "2. Login:", 6, "prose/table", True), ("d", 3, "Appendix", 1, "prose", False), ("d", 4, "Cart", 0, "prose", True), ("e", 1, "Glossary", 1, "?", False),
    ]
    d = spark.createDataFrame(
        [("d", "LOGIN", "keep", True, True, False), ("d", "login:", "create", False, None, False), ("d", "Appendix", "keep", True, True, True), ("d", "Invented", "update", True, False, False), ("d", None, "keep", True, True, False), ("e", "Login", "keep", True, True, False)],
        "prd_source string, prd_section string, action string, reviewed boolean, approved boolean, written_back boolean",
    )
    rows, unmatched = coverage.section_coverage(sections, d)
    got = {r.heading: (r.keep_count, r.create_count, r.approved_count, r.pending_count, r.gap_risk) for r in rows.collect()}
    assert got == {"(no heading)": (0, 0, 0, 0, "uncovered"), "2. Login:": (1, 1, 1, 1, "covered"), "Cart": (0, 0, 0, 0, "uncovered")}
    assert sorted(map(tuple, unmatched.collect())) == [("d", "Appendix"), ("d", "Invented"), ("e", "Login")]
    scores = {r.source_id: (r.n_testable, r.n_covered, r.coverage_score, list(r.unmatched)) for r in coverage.coverage_scores(sections, d).collect()}
    assert scores == {"d": (3, 1, 0.333, ["appendix", "invented"]), "e": (0, 0, None, ["login"])}


def test_passages_contexts_and_grounding(spark):
    hits = spark.createDataFrame(
        [("q", k, s, "Plan", h, f"text {k} [INST]x[/INST]", t) for k, s, h, t in ((1, 0.9, "Plan", None), (2, 0.89, " Part ", "T-1"), (3, 0.88, None, None), (4, 0.2, "late", None), (5, None, "none", None))] + [("r", 9, 0.1, None, None, None, None)],
        "query_id string, key int, score double, title string, heading string, text string, test_key string",
    )
    numbered = answers.passages(hits, 4)
    assert sorted((r.query_id, r.n, r.key) for r in numbered.collect()) == [("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("r", 1, 9)]  # the knee lies behind the third
    text = {r.query_id: r.context for r in answers.contexts(numbered).collect()}
    assert text == {"q": "[1] Plan\ntext 1 [FILTERED]\n\n---\n\n[2] Plan › Part  (test T-1)\ntext 2 [FILTERED]\n\n---\n\n[3] Plan\ntext 3 [FILTERED]", "r": "[1] untitled\n"}
    said = spark.createDataFrame([("q", "<think>[1]</think> As [3] and [2][3] say, not [7]."), ("r", "Not documented [1]."), ("s", "Sure [1]."), ("t", None)], "query_id string, answer string")
    judged = answers.grounded(said, numbered).cache()
    assert {r.query_id: (list(r.cited), r.abstained, r.grounded) for r in judged.collect()} == {"q": ([2, 3], False, True), "r": ([1], True, False), "s": ([], True, False), "t": ([], True, False)}
    assert sorted((r.query_id, r.n, r.key, r.score) for r in answers.citations(numbered, judged).collect()) == [("q", 2, 2, 0.89), ("q", 3, 3, 0.88), ("r", 1, 9, 0.1)]


def test_title_filters(spark):
    titles = ["PRD: Payments", "v1.2.3 : Analytics", "Notes v1.2", "Retro of May", "Implementation-plan", None, "", "PRDX"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    held = lambda *a: [r.t for r in rows.where(guards.title_filter(F.col("t"), *a)).collect()]
    assert held() == titles and held(("prd",)) == titles[:1] and held(("release_note", "nonsense")) == titles[1:2]
    assert held(("other",)) == ["Notes v1.2", None, "", "PRDX"] and held((), ("prd", "other")) == titles[1:] and held(("prd", "other"), ("prd",)) == held(("other",))


def test_bands_and_gates(spark):
    rows = spark.createDataFrame([(2.0, 0.0, True), (0.6, 0.1, True), (0.4, 0.1, True), (2.0, 0.012, False), (None, 0.025, True), (3.0, 0.001, None)], "rr double, rrf double, steps boolean")
    assert [r[0] for r in rows.select(guards.banded_row(F.col("rr"), F.col("rrf"), F.col("steps"))).collect()] == ["high", "medium", None, "medium", "high", None]
    metrics = spark.createDataFrame([("a", 0.6, 0.1, 0.5, 0.3), ("b", 0.6, 0.1, 0.3, 0.4)], "query string, recall double, precision double, mrr double, ndcg double")
    assert tuple(review.gate(metrics).select("mrr", "failed", "passes").first()) == (0.4, "ndcg", False)
    assert review.gate(metrics.limit(0)).first().passes is False


def test_long_series_keep_their_end(spark):
    events = spark.range(100).selectExpr("CASE WHEN id < 90 THEN 'long' ELSE 'short' END AS s", "id % 45 AS t", "id")
    kept = review.reservoir(events, "s", ["t", "id"], most=50, keep=4).collect()
    assert sorted((r.s, r.id) for r in kept) == [("long", 43), ("long", 44), ("long", 88), ("long", 89)] + [("short", k) for k in range(90, 100)]


def test_summaries_of_repeated_values(spark):
    values = [5] * 30 + [7] * 3 + [1, None]
    got = review.histogram_summaries(spark.createDataFrame([("g", v) for v in values] + [("h", 2), ("n", None)], "g string, v int"), "g", "v").collect()
    listed = sorted(v for v in values if v is not None)
    assert {tuple(r) for r in got} == {("g", 34, sum(listed), 1, 7, listed[17], listed[32]), ("h", 1, 2, 2, 2, 2, 2)}


def test_query_blocks_are_written_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows = spark.range(20).selectExpr("id AS k", "array(cast(id % 4 AS double), 1.0D, cast(id % 7 AS double)) AS embedding")
    asked = rows.where("k < 8").selectExpr("k AS query_id", "embedding AS q")
    many = sorted((r.query_id, r.k, r["rank"]) for r in search.knn(rows, asked, 3, "k").collect())
    best = sorted((r.k, r.best_score, r.nearest) for r in search.best_matches(rows, asked, "k").collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 2048)
    assert many == sorted((r.query_id, r.k, r["rank"]) for r in search.knn(rows, asked, 3, "k").collect())
    assert best == sorted((r.k, r.best_score, r.nearest) for r in search.best_matches(rows, asked, "k").collect())
