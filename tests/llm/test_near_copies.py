import random

import numpy as np

from vellum.llm import near_copies as N


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Smallest id of each component of texts at 0.8 or more, all pairs compared by shared shingles."""
    sets, root, holders = [grams(t) for _, t in rows], list(range(len(rows))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        met = {}
        for g in s or {()}:
            for j in holders.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            holders[g].append(k)
        for j, c in met.items():
            if sets[j] == s or 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                root[find(k)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        key = (i is None, i if i is not None else 0)
        best[find(k)] = min(key, best.get(find(k), key))
    return sorted(None if none else i for none, i in best.values() if not none), sum(none for none, _ in best.values())


def check(spark, rows, more=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as kept_id", "4 as n")
    got = N.keep_one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    want, nulls = brute_kept(rows)
    assert sorted(i for i in ids if i is not None) == want and sum(i is None for i in ids) == nulls


def test_edges(spark):
    long = [f"w{k}" for k in range(20_000)]
    rows = [(9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one TWO"), (4, "one"), (None, "alone a b c d e"), (None, "other f g h i j k"), (30, " ".join(long)), (31, " ".join(long[:17_000])), (31, " ".join(long[:17_000])), (40, "É x"), (41, "é x")]
    check(spark, rows)


def test_empty(spark):
    assert N.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_big_groups_and_shared_passages(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(400):  # variants, some beyond the similarity of any single leader
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(200)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    for i in range(400, 600):  # a passage in texts that are otherwise their own
        rows.append((i, " ".join(base[:80] + [f"y{i}_{k}" for k in range(rng.randrange(5, 120))])))
    check(spark, rows)


def test_prefixes_of_like_sets_meet():
    rng = np.random.default_rng(3)
    often = rng.integers(0, 50, N.BUCKETS).astype(np.int32)
    for n in [1, 2, 4, 5, 6, 9, 10, 45, 200]:
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            out = rng.integers(0, n // 5 + 1)
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[out:]], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 5 * common >= 4 * (len(x) + len(y) - common):
                a, b = N.prefix(x, often).tolist(), N.prefix(y, often).tolist()
                assert any(9 * min(len(x) - i, len(y) - b.index(g)) >= 4 * (len(x) + len(y)) for i, g in enumerate(a) if g in b)


def test_template_fill_ins(spark):
    """Texts of one frequent passage and words of their own share bands but neither link nor get lost; chains link across them."""
    rng, rows = random.Random(8), []
    for i in range(300):
        rows.append((i, " ".join([f"p{k}" for k in range(100)] + [f"f{i}_{k}" for k in range(rng.randrange(18, 40))])))
    w = [f"p{k}" for k in range(100)] + [f"g{k}" for k in range(40)]
    for i in range(300, 340):  # each a word further than the one before
        w = w[1:] + [f"h{i}"]
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
