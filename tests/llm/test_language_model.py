import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import language_model as L


def brute(rows):
    split = [(i, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (t or "").encode().split()] + [None]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in split if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in split), key=str)


def check(rows, got):
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_small_cases(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (None, "A b a"), (3, "x É y"), (3, "x É y")] + [(k, f"The cat {k % 5} sat on the mat number{k} " * (k % 4)) for k in range(4, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "2 as at", "true as train", "3 as score")
    check(rows, L.score_texts(docs).collect())
    assert L.score_texts(docs.limit(0)).count() == 0
    lone = L.score_texts(docs, train=docs.doc_id < 0).collect()
    assert {(r.score, r.train_tokens) for r in lone} == {(0.0, 0)}


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_groups_of_few_tokens(spark, order):
    """Empty, one-word and two-word texts alone or together in a partition, in every order."""
    texts = [None, "one", "two words", " \n "]
    rows = [(k, texts[order[k % 4]]) for k in range(8)] + [(100 + k, "some longer text to learn from") for k in range(3)]
    for parts in (1, 4, 11):
        spread = spark.sparkContext.parallelize(rows, parts).toDF("doc_id long, text string")
        check(rows, L.score_texts(spread).collect())


def model_of(texts, seed=None):
    """A model over these training texts, with random weights if a seed is given."""
    t = L.Tokens(texts, np.ones(len(texts), bool))
    total = np.bincount(t.ids, minlength=len(t.words)).astype(np.int64)
    model = L.Model(L.fit_clusters(t.words, total), list(zip(total.tolist(), t.words, strict=True)), len(t.ids))
    places = model.places(t.words, t.codes, total)
    model.mass = np.bincount(places, total, L.CLASSES * L.LEAVES).astype(float)
    model.once = np.bincount(places // L.LEAVES, total == 1, L.CLASSES).astype(float)
    if seed is not None:
        model.weights += np.random.default_rng(seed).normal(size=model.weights.shape).astype(np.float32)
    return t, total, model, places


def test_score_against_a_dense_brute_force():
    """Every known word's probability and the unseen word's, one by one from the definition; they sum to 1."""
    t, total, model, places = model_of(["aa bb aa cc dd cc ee", "bb bb ff aa", "aa"], 1)
    got = L.score_group(model, t.ids, t.lengths, L._short(t.codes), total, places)
    prior, inside = model.priors()
    mass = model.mass.reshape(L.CLASSES, L.LEAVES)
    unseen = np.minimum(model.once / np.maximum(mass.sum(1), 1), 0.95)
    history = L.histories(L._short(t.codes), places // L.LEAVES, t.ids, t.lengths, np.arange(len(t.ids)))
    for k in range(len(t.ids)):
        one = [h[k : k + 1] for h in history]
        soft = lambda w, rows, bias: np.exp(z := w[np.arange(L.FEATURES), [int(r[0]) for r in rows]].sum(0) + bias.astype(float)) / np.exp(z).sum()
        of_class = soft(model.weights[0], L.rows_of(one, model.slots), prior)
        p = np.zeros(len(t.words))
        for w, place in enumerate(places):
            c, leaf = divmod(int(place), L.LEAVES)
            of_leaf = soft(model.weights[1], L.rows_of(one, model.slots, np.array([c])), inside[c])
            p[w] = of_class[c] * of_leaf[leaf] * total[w] / model.mass[place] * (1 - unseen[c])
        assert np.isclose(np.log(p[t.ids[k]]), got[k], atol=1e-4)
        assert np.isclose(p.sum() + of_class @ unseen, 1, atol=1e-5)
    total[t.words.index(b"ff")] = 0  # as if never seen in training
    lone = L.score_group(model, t.ids, t.lengths, L._short(t.codes), total, places)
    at = int(np.flatnonzero(t.ids == t.words.index(b"ff"))[0])
    of_class = np.exp(z := sum(model.weights[0][f, L.rows_of([h[at : at + 1] for h in history], model.slots)[f][0]] for f in range(L.FEATURES)) + prior.astype(float)) / np.exp(z).sum()
    assert np.isclose(lone[at], np.log(of_class @ unseen), atol=1e-4)


def test_gradient_against_finite_differences():
    """A step of one example moves each weight row against the softmax's gradient, scaled by Adagrad."""
    rng = np.random.default_rng(3)
    weights, squares = rng.normal(size=(L.FEATURES, 16, 32)).astype(np.float32), np.full((L.FEATURES, 16), 1e-2, np.float32)
    rows, y, bias = [np.array([k, k, 5], np.uint16) for k in range(4)], np.array([3, 3, 9]), rng.normal(size=32).astype(np.float32)
    loss = lambda w: sum(np.log(np.exp(z := sum(w[f, rows[f][e]] for f in range(4)) + bias).sum()) - z[y[e]] for e in range(3))
    before = weights.astype(float)
    after = weights.copy()
    L._learn(after, squares, rows, y, bias)
    for f in range(4):
        for slot in set(rows[f].tolist()):
            grad = np.zeros(32)
            for j in range(32):
                up, down = before.copy(), before.copy()
                up[f, slot, j] += 1e-5
                down[f, slot, j] -= 1e-5
                grad[j] = (loss(up) - loss(down)) / 2e-5
            n = int((rows[f] == slot).sum())
            step = grad / n**0.5
            assert np.allclose(after[f, slot] - before[f, slot], -L.RATE * step / (1e-2 + (step**2).mean()) ** 0.5, atol=2e-3)


def test_every_training_position_gives_a_gradient():
    words = [f"w{k}" for k in range(300)]  # each follows one other: a feature row a position
    t, total, model, places = model_of([" ".join(words)])
    weights = model.weights.copy()
    n = L.learn_group(model, weights, np.full(weights.shape[:3], 1e-2, np.float32), t.ids, t.lengths, t.train, L._short(t.codes), places)
    assert n == 301
    history = L.histories(L._short(t.codes), places // L.LEAVES, t.ids, t.lengths, np.arange(len(t.ids)))
    for level, of in ((0, None), (1, places[t.ids] // L.LEAVES)):
        for f, rows in enumerate(L.rows_of(history, model.slots, of)):
            assert (weights[level][f, rows] != 0).any(1).all()


def test_clusters_are_fitted_to_every_training_word(spark):
    rows = [(k, " ".join(f"{chr(97 + j % 26)}{j}x{k}" for j in range(300)), True) for k in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    seen, fit = [], L.fit_to_all

    def spy(sums):
        seen.append(fit(sums))
        found = [w for r in sums.collect() for w in bytes(r.words).split(b"\n")]
        counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sums.collect()])
        assert set(found) == {w.encode() for _, t, _ in rows for w in t.split()} | {L._END}
        assert np.array_equal(seen[0], L.fit_clusters(found, counts))
        return seen[0]

    L.fit_to_all = spy
    try:
        assert L.score_texts(docs, train=docs.train).count() == 450 and seen
    finally:
        L.fit_to_all = fit


def test_groups_keep_all_texts(monkeypatch, spark):
    """Small groups, one very long text and repeated rows: the same counts and base scores."""
    monkeypatch.setattr(L, "GROUP", 2000)
    rows = [(k, f"some words {k % 9} here " * (k % 30)) for k in range(300)] + [(7, "again and again")] * 50 + [(900, "long text " * 30_000)]
    check(rows, L.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [L.slots(n) for n in (0, L.FULL, 4 * L.FULL, 1 << 60)] == [1 << 12, 1 << 13, 1 << 14, 1 << 16]


def test_held_out_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = L.op6(spark, sf).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_tokens_are_those_of_split():
    texts = ["A b\ta\n\x0bB  c\r\x0c", None, "", " \n ", "É é x y z" * 3, "\x1c\x85 a", "b"]
    t = L.Tokens(texts, np.ones(len(texts), bool))
    want = [[*(x or "").encode().lower().split(), b" "] for x in texts]
    assert [t.words[k] for k in t.ids] == [w for x in want for w in x] and t.lengths.tolist() == [len(x) for x in want]


def test_row_sums_of_short_and_long_stretches():
    rng = np.random.default_rng(5)
    times = np.sort(np.concatenate([rng.integers(1, 12, 60), [700, 65, 64, 17, 16, 9, 8, 1]]))[::-1]
    n = int(times.sum())
    g, order = rng.random((n, 32), np.float32), rng.permutation(n)
    begin = np.cumsum(times) - times
    want = [g[order[a : a + k]].astype(float).sum(0) for a, k in zip(begin, times, strict=True)]
    assert np.allclose(L._row_sums(g, order, begin, times), want, rtol=1e-5)
