import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Scores of every document for every item, by the definition."""
    held = [(i, w, Counter(w)) for i, t in docs if (w := split(t))]
    n, total = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for *_, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(split(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, w, c in held:
            m = 100 - 75 + (75 * len(w) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in want.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as term", "'s' as shard", "2 as score")
    return docs, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id", "'t' as term")


def held(found):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()], key=str)


def test_hard_cases(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Ünder", "STRAßE", "x_y", "it's", "日本", "A1"]
    docs = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, "the hot passage w1 w2") for k in range(200)] + [(7, "the hot passage w1 w2")] * 2 + [(None, "the hot passage w1 w2"), (None, None), (2000, ""), (2001, " -,;\n "), (2002, "w3 " * 30_000)]
    items = [(1, "hot W1 w1"), (2, "ÜNDER straße w39"), (3, None), (4, ""), (5, "nowhere"), (None, "日本 a1"), (6, "w5 w6"), (6, "w5 w7"), (8, " ".join(words))]
    for k, shard, ask in ((10, 1 << 25, 1 << 22), (3, 2000, 100), (500, 9000, 1 << 22)):
        assert held(S.search(*frames(spark, docs, items), k, shard, ask)) == brute(docs, items, k)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([(1, "a")], []), ([], [(1, "a")]), ([(1, None)], [(1, "a")])])
def test_empty_sides(spark, docs, items):
    assert held(S.search(*frames(spark, docs, items))) == []


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert held(S.op12(spark, sf_dir)) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"), 10)


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for top in (200, 60_000, 1 << 31):
        values = rng.integers(0, top, 1000)
        starts = np.arange(0, 1000, 128)
        data, widths, ends = S.compress(values, starts)
        at = np.concatenate([[0], ends[starts[1:] - 1]])
        got = [S.decompress(data.tobytes(), int(a), min(128, 1000 - s), int(w)) for s, a, w in zip(starts.tolist(), at, widths, strict=True)]
        assert (np.concatenate(got) == values).all()


def test_blocks_below_the_threshold_stay_compressed():
    """Ten documents hold a rare term often; the frequent term's other blocks are never opened."""
    n = 128 * 40
    m = np.full(n, 100)

    def postings(docs, counts):
        shard = S._Shard()
        shard.ids, shard.ms, shard.sizes = list(range(n)), m.tolist(), [0] * n
        docs, counts = np.array(docs), np.array(counts)
        starts = np.arange(0, len(docs), S.BLOCK)
        last = docs[np.append(starts[1:], len(docs)) - 1]
        gaps, gw, _ = S.compress(np.diff(docs, prepend=0), starts)
        packed, cw, _ = S.compress(counts, starts)
        peak = np.maximum.reduceat(S.impact(counts, m[docs]), starts)
        return S._Postings(len(docs), last.astype("<u4").tobytes(), peak.astype("<u4").tobytes(), (gw * 16 + cw).astype(np.uint8).tobytes(), gaps.tobytes(), packed.tobytes(), m)

    common, rare = postings(range(n), [1] * n), postings(range(300, 310), [9] * 10)
    docs, _ = S.best([(1, common), (1000, rare)], n, 10)
    assert docs.tolist() == list(range(300, 310))
    assert sum(b is not None for b in common.open) < 20 < len(common.open)
