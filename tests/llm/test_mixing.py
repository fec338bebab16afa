import numpy as np

from vellum.llm import mixing as M


def test_small_cases(spark):
    rows, labels = [], []
    for k in range(300):
        text = f"plain words number{k} about a thing{k % 9} " * (3 + k % 5)
        text += "idiot scum " if k % 10 == 0 else ""
        text = text.replace(" ", "### ") if k % 10 == 1 else text
        rows.append((k, text))
        if k % 2 == 0 or k % 10 == 1:
            labels.append((k, int(k % 10 != 1), int(k % 10 == 0)))
    rows += [(None, "x y"), (900, None), (901, ""), (902, "same"), (902, "same")]
    labels += [(5000, 1, 1), (2, None, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rate", "'q' as clean", "5 as copies")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = M.rates(docs, known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[k].p_toxic > 0.5 for k in range(0, 300, 10)]) > 0.9 and np.mean([by[k].p_clean > 0.5 for k in range(3, 300, 10)]) > 0.9
    words = sum(r.n_words for r in got)
    for d in M.DOMAINS:  # the rates' expected words match the targets
        assert abs(sum(r.rate * r.n_words * r[f"p_{d}"] for r in got) / words / M.TARGETS[d] - 1) < 0.01
    assert all(r.rate >= 0 and r.rate - 1 < r.copies < r.rate + 1 and r.misfit <= M.CLOSE for r in got)
    assert all(by[k].copies >= 1 for k in range(3, 300, 10))
    mixed = M.mix(docs, known)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert M.rates(docs.limit(0), known).count() == 0 and M.mix(docs.limit(0), known).count() == 0
    assert {r.copies for r in M.rates(docs, known.limit(0)).collect()} <= {0, 1, 2}


def test_descent_against_plain_numpy(spark):
    p = np.array([(1, 0, 0), (0.75, 0.25, 0), (0, 1, 0), (0.05, 0, 0.95)])
    t = np.array([5000.0, 700, 400, 900])
    names = [f"{a}_{d}" for a in ("p", "words") for d in M.DOMAINS]
    cells = spark.createDataFrame(np.hstack([p, p * t[:, None]]).tolist(), ", ".join(f"{n} double" for n in names))
    history, misfit = M.fit_rates(cells, M.TARGETS)
    x, goal = np.ones(4), np.array([M.TARGETS[d] for d in M.DOMAINS]) * t.sum()
    for step in history:
        x = np.maximum(0, x - p @ np.array(step))
    assert np.abs(((x * t) @ p - goal) / goal).max() <= M.CLOSE and misfit <= M.CLOSE
    # with every rate above 0 the answer is the one nearest to 1 that meets the targets, weighted by words
    assert np.allclose(x, 1 - p @ np.linalg.solve(p.T @ (p * t[:, None]), p.T @ t - goal), atol=1e-2)


def test_targets_out_of_reach(spark):
    """All documents alike: no rates meet the targets, and the misfit says so."""
    docs = spark.createDataFrame([(k, "same text") for k in range(20)], "doc_id long, text string")
    got = M.rates(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len({r.rate for r in got}) == 1 and got[0].misfit > 1


def test_clashing_names_and_long_text(spark):
    names = ["mix_words", "mix_clean", "mix_low", "mix_toxic", "mix_copy", "mix_id", "mix_copies", "mix_rate", "cell_clean", "MIX_HASH"]
    rows = [(k, f"word{k % 7} plain text " * (20_000 if k == 3 else 5), *range(len(names))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    known = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    got = M.mix(docs, known)
    assert got.columns == docs.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in got.collect())
    assert {r.n_words for r in M.rates(docs, known).collect()} == {15, 60_000}


def test_whole_table(spark, sf_dir):
    got = M.op5(spark, sf_dir).collect()
    words = sum(r.n_words for r in got)
    assert len(got) == 200
    for d in M.DOMAINS:
        assert abs(sum(r.rate * r.n_words * r[f"p_{d}"] for r in got) / words / M.TARGETS[d] - 1) < 0.05


def test_texts_come_in_small_batches(spark, monkeypatch):
    plain = M._posteriors

    def watched(*args):
        run = plain(*args)

        def small(batches):
            return run(b if b.num_rows <= 256 else 1 / 0 for b in batches)

        return small

    monkeypatch.setattr(M, "_posteriors", watched)
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('some words ', id % 7) AS text").coalesce(1)
    labels = spark.range(900).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 3 = 0 AS int) AS toxic")
    assert M.mix(docs, labels).select("doc_id").distinct().count()
