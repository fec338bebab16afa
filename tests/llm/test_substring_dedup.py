import hashlib
import random
from collections import Counter

from vellum.llm import substring_dedup as S
from vellum.llm.substring_dedup import op2, remove_repeated_windows


def brute(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_small_cases(spark):
    rng = random.Random(1)
    shared = [f"s{rng.random()}" for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (None, "a b"), (3, "x " * 200), (4, "x " * 200), (4, "x " * 200)]
    for i in range(5, 40):
        own = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        at = rng.randrange(0, 25)
        rows.append((i, " ".join(own[:20] + shared[at : at + rng.randrange(20, 60)] + own[20:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'q' as g", "'z' as kept_text")
    for width in (3, 35):
        got = remove_repeated_windows(docs, width).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows, width)
        for r in got:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
            assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op2(spark, sf_dir).collect()), key=str) == brute(rows, 35)


def test_rows_repeated_beyond_a_group(spark, monkeypatch):
    """Repeated rows that fill several groups, and one very long text."""
    monkeypatch.setattr(S, "GROUP", 4000)
    rows = [(7, "one passage that comes again and again " * 3)] * 300 + [(k, f"text number{k} with words of its own") for k in range(60)]
    rows += [(900, " ".join(f"w{k}" for k in range(30_000)))]
    got = S.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows, 5)
