import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from vellum.llm import decontamination as D


def test_small_cases(spark):
    rng = random.Random(5)
    item = [f"q{rng.randrange(40)}" for _ in range(40)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    text = lambda *parts: "  ".join(" ".join(p) for p in parts)
    late = item[:-3] + noise(3)
    swapped = [x for k in range(0, 40, 2) for x in (item[k], f"z{k}")]
    docs = [
        (1, text(noise(100), [x.upper() for x in item], noise(50))), (2, text(noise(20), late, noise(9))), (3, text(noise(30), swapped)),
        (4, None), (5, ""), (6, text(item[:37])), (7, text(noise(300))), (8, text(noise(3), ["tiny", "item"], noise(3))), (1, "clean words only"),
        (None, text(item)), (9, text(noise(5), item[:20], noise(20))), (10, text(item, noise(4), item)),
    ]
    items = [(70, " ".join(item)), (71, "Tiny item"), (72, None), (73, " "), (70, " ".join(item))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as item_id", "3 as leak_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(d, b).collect()}
    assert set(got) == {(1, 70), (2, 70), (6, 70), (None, 70), (8, 71), (10, 70)}
    assert got[1, 70].similarity == 1 and got[1, 70].start_word == 100 and got[10, 70].start_word == 0
    left = D.remove_leaks(d, b)
    assert left.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in left.where("doc_id = 1").collect()) == [(1, "clean words only")]
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 7, 9]


def test_a_leak_with_its_halves_swapped(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    item, text = a + b, [f"n{k}" for k in range(17)] + b + a + [f"m{k}" for k in range(9)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(b + a))], "doc_id long, text string")
    got = D.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    best = max((len(shingles(item) & (x := shingles(text[s : s + 60]))) / len(shingles(item) | x), -s) for s in range(len(text)))
    assert {(r.doc_id, r.item_id, r.similarity, r.start_word) for r in got} == {(1, 7, best[0], -best[1]), (2, 7, best[0], 0)} and best == (52 / 60, -17)


def test_fingerprints_and_index(spark):
    """Fingerprints of few and many hashes, and every pair within the radius meeting in exactly one first block."""
    rng = random.Random(1)
    hashes = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 9, 127, 128, 300, 40_000)]
    got = spark.createDataFrame([(k, h) for k, h in enumerate(hashes)], "k long, h array<long>").select("k", D._simhash(F.col("h")).alias("fp")).collect()
    for r in got:
        h = hashes[r.k]
        assert r.fp % (1 << 64) == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    base = rng.randrange(1 << 63)
    flipped = [(k, base ^ sum(1 << b for b in rng.sample(range(63), k % 26))) for k in range(300)]
    items = spark.createDataFrame([(1, 9, base)], "item_id long, n int, fp long")
    near = spark.createDataFrame(flipped, "k long, fp long").select("*", F.posexplode(F.array(*[D._block(F.col("fp"), j) for j in range(len(D.BLOCKS))])).alias("block", "code"))
    met = {r.k for r in near.join(D._index(items), ["block", "code"]).collect()}
    assert {k for k, _ in flipped if k % 26 <= D.RADIUS} <= met


def test_recall_against_all_windows(spark):
    """Passages near the similarity: everything that a comparison of all windows finds."""
    rng = random.Random(3)
    items = {k: [f"i{k}w{rng.randrange(30)}" for _ in range(rng.choice((12, 30, 60)))] for k in range(30)}
    docs = []
    for k in range(60):
        w = list(items[k % 30])
        for _ in range(rng.randrange(3)):  # words replaced, near the ends more often
            w[rng.choice((0, 1, 2, -1, -2, rng.randrange(len(w))))] = "changed"
        docs.append((k, [f"n{rng.randrange(9999)}" for _ in range(rng.randrange(30))] + w + [f"n{rng.randrange(9999)}" for _ in range(rng.randrange(30))]))
    want = {}
    for d, w in docs:
        for i, x in items.items():
            need = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
            for start in range(-len(x), len(w)):
                have = Counter(tuple(c[k : k + 5]) for c in (w[max(start, 0) : start + len(x)],) for k in range(len(c) - 4))
                common = sum((need & have).values())
                if common and (s := common / sum((need | have).values())) >= D.SIMILARITY and s > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (s, max(start, 0))
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{n} long, text string") for rows, n in ((docs, "doc_id"), (items.items(), "item_id"))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in D.leaks(*frames).collect()}
    assert len(want) > 20 and got == want


def test_very_long_text_and_clashing_names(spark):
    item = [f"q{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join([f"n{k}" for k in range(100_000)] + item), 7, 8), (2, "clean", 7, 8)], "doc_id long, text string, own_id int, leak_hash int")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.start_word) for r in D.leaks(docs, items).collect()] == [(1, 100_000)]
    assert [tuple(r) for r in D.remove_leaks(docs, items).collect()] == [(2, "clean", 7, 8)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert D.leaks(some, items.limit(0)).count() == 0 and D.remove_leaks(some, items.limit(0)).count() == 1


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(D.SQL).fetchall())
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start_word) for r in D.op3(spark, sf_dir).collect())
    assert got == want and want
