import tracemalloc

import numpy as np
import xxhash

from vellum.llm import simhash_dedup as S
from vellum.llm.common import persist


def brute_fp(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    fp = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((i, f"{fp[k]:016x}", ids.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in df.collect()), key=str)


def test_small_cases(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One Two"), (8, "one two"), (7, "É one"), (6, "é one"), (20, long), (21, long + " more"), (21, long), (None, "alone x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root", "3 as n")
    assert found(S.components(docs)) == brute_components(rows)
    kept = S.keep_one_of_each(docs.union(docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in {r[2] for r in brute_components(rows)})
    assert len(kept[0]) == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.components(docs).count() == 0 and S.keep_one_of_each(docs).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op7(spark, sf_dir).collect()), key=str) == brute_components(rows)


def test_search_is_exact_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    near = centre.repeat(20)
    for _ in range(2):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    fps = np.unique(np.concatenate([centre, near, rng.integers(0, 1 << 63, 3000).astype(np.uint64)]))
    label = S._block_components(fps, 2)
    monkeypatch.setattr(S, "SHARD", 300)
    monkeypatch.setattr(S, "LEAF", 40)
    df = persist(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "fps")
    roots = dict(map(tuple, S.connected_components(S.links(df)).collect()))
    for x, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        first = int(fps.view(np.int64)[k])
        assert roots.get(x, x) == roots.get(first, first)
    assert len({roots.get(int(x), int(x)) for x in fps.view(np.int64)}) == len(set(label.tolist()))


def test_shards_keep_their_size(spark, monkeypatch):
    """Small samples and shards: every shard is dealt on until it is small, and the components are those of brute force."""
    monkeypatch.setattr(S, "SAMPLE", 300)
    monkeypatch.setattr(S, "SHARD", 40)
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 64, 6000, np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900, np.uint64))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    seen, deepened = [], S._deepened
    monkeypatch.setattr(S, "_deepened", lambda routed, radius: seen.append(deepened(routed, radius)) or seen[0])
    edges = {frozenset((r.a, r.b)) for r in S.links(df).collect()}
    assert seen[0].groupBy("shard").count().agg({"count": "max"}).first()[0] <= 4 * 40
    near = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= 2]]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    assert len(near) > 800 and edges == {frozenset((signed(a), signed(b))) for a, b in near}


def test_copies_within_few_bits_take_little_memory():
    flips = [0, *(1 << a for a in range(64)), *(1 << a | 1 << b for a in range(64) for b in range(a))]
    fps = np.array([0x5DEECE66D1234567 ^ x for x in flips], np.uint64)
    tracemalloc.start()
    label = S._block_components(fps, 4)  # every pair links
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not label.any() and peak < 20 << 20


def test_blocks_against_all_pairs(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    fps = np.random.default_rng(3).integers(0, 1 << 10, 150).astype(np.uint64) << np.uint64(40)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 1
    for _ in range(8):
        near = near @ near
    assert S._block_components(fps, 1).tolist() == near.argmax(1).tolist()
