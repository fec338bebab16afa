import hashlib
import math
import random
from collections import defaultdict

import pytest

from vellum.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    """Plain Lloyd over all vectors, one row after the other."""
    kept = [(i, label, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(q) for *_, q in kept), default=0) // parts))
    kept = [(i, label, q + [0] * (parts * width - len(q))) for i, label, q in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for *_, q in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for *_, q in kept:
            for p in range(parts):
                held[p, near(p, cut(q, p))[1]].append(cut(q, p))
        for (p, e), vs in held.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, label, q in kept:
        found = [near(p, cut(q, p)) for p in range(parts)]
        out.append((i, label, [e for _, e in found], sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted([(*r, by_label[r[1]]) for r in out], key=str), text


def held(coded):
    return sorted([(r.vec_id, r.label, list(r.codes), r.error, r.label_error) for r in coded.collect()], key=str)


def test_hard_cases(spark):
    rng = random.Random(3)
    hot = [0.25, -0.5, 0.125, 1.0, 0.0]
    rows = [(k, hot if k % 3 == 0 else [rng.uniform(-1, 1) for _ in range(5)], k % 4 or None) for k in range(120)]
    rows += [(5, [0.1] * 5, 1), (5, [0.1] * 5, 1), (None, [0.3] * 5, 2), (None, None, 2), (900, None, None), (901, [0.1, None, 0.0, 0.0, 0.0], 1), (902, [], 7)]
    rows += [(903, [float("nan")] * 5, 1), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (905, [1e30, -1e30, 0.0, 0.0, 0.0], 1), (906, [0.5], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as at", "1 as pos", "2L as part", "3 as weight", "'q' as codes")
    for parts, entries in ((2, 7), (3, 200)):
        coded, books = V.compress(vectors, parts, entries)
        expected, text = brute(rows, parts, entries, 2)
        assert held(coded) == expected and V.books_text(books) == text


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(1, [], None)]])
def test_few_or_no_vectors(spark, rows):
    coded, books = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 4)
    expected, text = brute(rows, 4, 64, 2)
    assert held(coded) == expected and V.books_text(books) == text


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected, text = brute(rows, 16, 64, 2)
    got = sorted(map(tuple, V.op11(spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert got == sorted((i, "".join(f"{c:02x}" for c in codes), error, label_error, sha) for i, _, codes, error, label_error in expected)
