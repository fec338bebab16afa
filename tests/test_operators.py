import datetime as dt

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import guards, ingest, review, search
from vellum.sources import files
from vellum.streaming.debounce import debounced, debounced_stream


def test_separation_of_a_compressed_list(spark):
    scores = [0.8365, 0.7954, 0.7948, 0.7945, 0.7941, 0.7937, 0.7933, 0.7929, 0.7925, 0.7921, 0.7917, 0.7913, 0.7909, 0.7905, 0.7902]
    df = spark.createDataFrame([("q", k, s) for k, s in enumerate(scores)] + [("flat", k, 0.5) for k in range(8)], "g string, key int, score double")
    got = {r.g: r for r in search.separation(df, "g").collect()}
    assert got["q"].kept == 3 and got["q"].usable and got["q"].top_z > 5 and not got["flat"].usable and got["flat"].kept == 8
    assert {r.g: r.kept for r in search.separation(df, "g", 1).collect()}["q"] == 1


def test_titles(spark):
    cases = {"Implementation Plan for the Account PRD": "implementation_plan", "QA plan": "test_plan", "Account PRD": "prd", "HLD": "tech_doc", "v2.1 hotfix": "release_note", "Daily review": "meeting_note", "Lunch": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", T.doc_type(F.col("t")).alias("k")).collect()} == cases


def test_auto_approval_gates(spark):
    d = spark.createDataFrame([(k, "keep", "high", True, True) for k in range(40)] + [(100, "keep", "high", False, None), (101, "keep", None, False, None), (102, "deprecate", "high", False, None), (103, "update", "high", False, None)], "id int, action string, confidence string, reviewed boolean, approved boolean")
    assert {r.id: r.reason for r in review.auto_approval(d, 0.95, 20).collect()} == {100: None, 101: "low_confidence", 102: "needs_human", 103: "few_samples"}


def test_rrf_prefers_agreement(spark):
    a = spark.createDataFrame([("q", "A", 2), ("q", "B", 1)], "query_id string, jira_key string, rank int")
    b = spark.createDataFrame([("q", "A", 2)], "query_id string, jira_key string, rank int")
    got = search.rrf(a, b, k=5, base=1).collect()
    assert [r.jira_key for r in sorted(got, key=lambda r: r["rank"])] == ["A", "B"] and {r.jira_key: r.rrf for r in got}["B"] == round(1 / 61, 6)


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=k * 137 % 5000), k % 4) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, page_id long")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = debounced_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("accepted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select page_id, event_id from accepted").collect())) == sorted(map(tuple, debounced(events).collect()))


def test_orphans_take_every_row_without_a_cap(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(60, 8))
    v[30:] = -np.abs(v[30:])
    v[0] = 1.0
    rows = spark.createDataFrame([(f"P-{k}", x.tolist() if k != 5 else None) for k, x in enumerate(v)], "jira_key string, embedding array<double>")
    chunks = spark.createDataFrame([(k, f"d{k}", v[k].tolist()) for k in range(0, 60, 7)], "query_id int, source_id string, q array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    scores = ((1 + u[::7] @ u.T) / 2).round(6)
    got = {r.jira_key: (r.best_score, r.nearest_source, r.has_vector) for r in search.orphans(rows, chunks, 0.64).collect()}
    want = {f"P-{k}": (scores[:, k].max(), f"d{7 * scores[:, k].argmax()}", True) for k in range(60) if scores[:, k].max() < 0.64 and k != 5}
    assert got == want | {"P-5": (None, None, False)} and want


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b!.md").write_text("plain")
    (tmp_path / "d" / "x.txt").write_text("# has title")
    (tmp_path / "d" / "x.xls").write_text("no")
    got = {r.source_id: (r.source_type, r.text) for r in files.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"file:upload:a b_.md": ("file_md", "# a b!.md\n\nplain"), "file:upload:x.txt": ("file_txt", "# has title")}


def test_duplicates_at_the_default_thresholds(spark):
    near = lambda x: [1.0, x]
    rows = spark.createDataFrame([("same", near(0.0)), ("close", near(1.0)), ("far", [-1.0, 0.1])], "jira_key string, embedding array<double>")
    asked = spark.createDataFrame([("q1", near(0.05)), ("q2", [0.35, -1.0]), ("q3", near(-0.75))], "query_id string, q array<double>")
    got = {r.query_id: (r.nearest, r.verdict) for r in search.nearest(rows, asked, 3, "jira_key").collect()}
    assert got == {"q1": ("same", "block"), "q2": ("same", "ok"), "q3": ("same", "warn")}


def test_query_blocks(spark, monkeypatch):
    """Queries in several blocks give the ranks that one block gives."""
    rows = spark.createDataFrame([(f"k{k:02d}", [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "jira_key string, embedding array<double>")
    asked = rows.select(F.col("jira_key").alias("query_id"), F.col("embedding").alias("q"))
    whole = sorted(map(tuple, search.knn(rows, asked, 5).collect()))
    best = sorted(map(tuple, search.best_matches(rows, asked).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, search.knn(rows, asked, 5).collect())) == whole and sorted(map(tuple, search.best_matches(rows, asked).collect())) == best


def test_steps_and_outlines(spark):
    cases = {'[{"action":"a"},{"action":" "}]': None, "[]": None, "x": None, '[{"action":" a ","result":"r"}]': [("a", "", "r", 1)]}
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", guards.valid_steps(F.col("j")).alias("s"))
    assert {r.j: r.s and [tuple(x) for x in r.s] for r in df.collect()} == cases
    texts = {"1. do x -> y\nprose\n- z": [("do x", "y"), ("z", "")], "only prose": None, "Step 2: a | Expected: b": [("a", "b")], None: None}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", guards.outline_steps(F.col("t")).alias("s"))
    assert {r.t: r.s and [tuple(x) for x in r.s] for r in df.collect()} == texts


def test_triage_turns(spark):
    df = spark.createDataFrame([(n,) for n in (30, 20, 10, 5, 2)], "n int")
    assert [r[0] for r in df.select(guards.triage_turn(F.col("n"))).collect()] == [20, 10, 7, 3, None]


def test_views_of_the_caller_stay(spark, sf_dir):
    from vellum.plans.logical import logical

    spark.range(3).createOrReplaceTempView("orders")
    assert logical(spark, sf_dir, "decisions").count() > 3 and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_replacement_keeps_what_failed(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "source_id string, chunk int")
    new = spark.createDataFrame([("a", 8), ("a", 9), ("b", 9)], "source_id string, chunk int")
    intended = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "source_id string, n_intended int")
    assert sorted(map(tuple, ingest.replaced_by_source(old, new, intended).collect())) == [("a", 8), ("a", 9), ("b", 1), ("b", 9), ("c", 1)]
