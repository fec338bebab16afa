import zlib

import numpy as np

from vellum.llm import quality_classifier as Q


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_small_cases(spark):
    rows = [(0, None), (1, ""), (None, "a b"), (2, "ABC!! " * 30), (3, " ".join(f"word{k}" for k in range(90))), (3, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label", "3 as n_words")
    none = spark.createDataFrame([(9, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = Q.score(docs.drop("score"), Q.fit(docs, none)).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert Q.score(docs.limit(0).drop("score"), Q.fit(docs.limit(0), none)).count() == 0
    s = docs.select("doc_id", Q.statistics(docs.text).alias("s")).where("doc_id = 2").first().s
    assert (s.n_words, s.word_length, s.bang_rate, s.upper_rate, s.distinct_rate) == (30, 5, 2, 0.6, round(1 / 30, 6))


def test_columns_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(Q.STATISTICS))).round(6)
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7) | (rng.random(800) < 0.05)).astype(float)
    rules = Q.fit_rules(x, y)
    assert 0 < len(rules.rules) < 200 and np.mean((rules.score(x) >= 0.5) == y) > 0.9
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{k} double" for k in Q.STATISTICS)).selectExpr(f"struct({', '.join(Q.STATISTICS)}) as s")
    assert np.allclose([r[0] for r in df.select(rules.column(df.s)).collect()], rules.score(x))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op1(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r.score, q) for r, q in labels if r.held_out]
    s, y = np.array([x for x, _ in held]), np.array([q for _, q in held])
    print("AUC", auc(s, y), "accuracy", np.mean((s >= 0.5) == y))
    assert auc(s, y) > 0.9 and np.mean((s >= 0.5) == y) > 0.9
