from pyspark.sql import functions as F

from vellum.operators import rerank as R

ROWS = [
    ("q1", "red apple pie", 1, "a", "green apple", None, None), ("q1", "red apple pie", 2, "b", "Red APPLE pie!", None, None), ("q1", "red apple pie", 3, "c", "apple tart", None, None),
    ("q1", "red apple pie", 4, "d", "  ", " pie, red ", "apple"), ("q1", "red apple pie", 5, "e", None, None, None), ("q2", " ", 1, "f", "x", None, None), ("q2", " ", 2, "g", "y", None, None), ("q3", None, 1, "h", "z", None, None),
]
SCHEMA = "query_id string, query string, rank long, key string, summary string, description string, steps_text string"


def test_order_ties_and_passing(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.key: (r.query_id, r["rank"], r.rerank_score, r.empty_text) for r in R.rerank(rows, R.LexicalOverlap).collect()}
    assert got == {
        "b": ("q1", 1, 1.0, False), "d": ("q1", 2, 1.0, False), "a": ("q1", 3, 0.3333, False), "c": ("q1", 4, 0.3333, False), "e": ("q1", 5, 0.0, True),
        "f": ("q2", 1, None, False), "g": ("q2", 2, None, False), "h": ("q3", 1, None, False),
    }
    assert sorted(r.key for r in R.rerank(rows, R.LexicalOverlap, 1).collect()) == ["b", "f", "h"]
    assert R.rerank(rows.limit(0), R.LexicalOverlap, 3).count() == 0


def test_a_scorer_is_made_once_a_task_and_rounded(spark):
    class Counted:
        made = 0

        def __init__(self):
            Counted.made += 1

        def __call__(self, pairs):
            return [Counted.made + 0.00005 * (len(text) % 2) for _, text in pairs]

    rows = spark.range(3000).select(F.lit("q").alias("query_id"), F.lit("ask").alias("query"), F.col("id").alias("rank"), F.col("id").cast("string").alias("summary"))
    assert {r.rerank_score for r in R.rerank(rows, Counted).select("rerank_score").distinct().collect()} <= {1.0, 1.0001}


def test_text_within_the_budget(spark):
    rows = [("s" * 1000, " " + "d" * 500, "t" * 400), ("s" * 2000, "d", "t"), (None, "\n", "t"), ("", None, None)]
    frame = spark.createDataFrame(rows, "summary string, description string, steps_text string").withColumn("doc_title", F.lit("T")).withColumn("section_heading", F.lit(None).cast("string"))
    got = [r[0] for r in frame.select(R.document_text(frame)).collect()]
    assert got == ["s" * 1000 + "\n" + "d" * 344, "s" * 1344, "T\nt", "T"]
    chunks = spark.createDataFrame([("body", "summary")], "chunk_text string, summary string")
    assert chunks.select(R.document_text(chunks)).first()[0] == "body"


def test_fetch_sizes():
    assert [R.fetch_size(10), R.fetch_size(20, "answer"), R.fetch_size(8, "answer"), R.fetch_size(10, "validate"), R.fetch_size(0, "preview", 30), R.fetch_size(0, "preview", 300)] == [30, 50, 32, 50, 30, 100]
