import re
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(tri)
    cov = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w))


def check(spark, rows, got):
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want


def test_small_cases(spark):
    many = " ".join(f"a{k % 300} b{k % 300} c{k % 7}" for k in range(1500))
    texts = [None, "", " \n\t", "a b", "a b a b a b", "é𝄞 x|y\n\n é𝄞 x|y\né𝄞 x|y", "\n a\n a\n", "x " * 1000, many, " ".join(map(str, range(900))), "a b c"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a b"), (None, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' as source", "1 as rule_words", "2 as host", "3 as n_words")
    check(spark, rows, Q.judge(docs).collect())
    kept = Q.keep(docs.drop("rule_words"))
    assert kept.columns == ["doc_id", "text", "source", "host", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in rows if not brute(t)[5])


def test_hosts(spark):
    good = " ".join(map(str, range(100)))
    rows = [(k, "bad" if k % 100 else good, "spam") for k in range(400)]
    rows += [(1000 + k, good if k % 5 else "bad", f"h{k % 6}") for k in range(600)]
    rows += [(2000, "bad", "one"), (2001, "bad", "one"), (2002, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert {i for i, r in got.items() if not r.base_failed and not r.kept} == {0, 100, 200, 300}
    assert {r.doc_id for r in Q.keep(docs).collect()} == {i for i, r in got.items() if r.kept}
    few = Q.fallen_hosts(docs.withColumn("failed", F.lit(False)), "source")
    assert few.count() == 0


def test_clashing_names(spark):
    names = ["rule_failed", "host_falls", "fallen_host", "Failed", "host", "words"]
    docs = spark.createDataFrame([(k, "w " * (10 if k < 3 else 1) + " ".join(map(str, range(60))) if k else "bad", "h", *range(6)) for k in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = Q.keep(docs)
    assert got.columns == docs.columns and sorted(tuple(r)[:1] + tuple(r)[3:] for r in got.collect()) == [(k, *range(6)) for k in range(1, 9)]


def test_kept_against_brute_force(spark, sf_dir):
    """Verdicts of hosts recomputed in plain Python from the base rules."""
    good = " ".join(map(str, range(100)))
    rows = [(k, "bad" if k % 100 else good, "spam") for k in range(400)] + [(1000 + k, good if k % 5 else "bad", f"h{k % 6}") for k in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for docs in (made, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r.doc_id, r.source, brute(r.text)[5]) for r in docs.collect()]
        n, k = Counter(h for _, h, _ in rows), Counter(h for _, h, f in rows if f)
        total, m = sum(n.values()), min(max(sum(k.values()) / sum(n.values()), 1e-3), 1 - 1e-3)
        scatter = sum(k[h] * k[h] / n[h] for h in n) - total * m * m
        between = max((scatter - (len(n) - 1) * m * (1 - m)) / max(total - sum(x * x for x in n.values()) / total, 1e-9), 1e-6)
        s = min(max(m * (1 - m) / between - 1, 2.0), 1000.0)
        falls = set()
        for h in n:
            a, b = m * s + k[h], (1 - m) * s + n[h] - k[h]
            if a / (a + b) - Q.BOUND * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5 > Q.HOST_LIMIT:
                falls.add(h)
        assert {r.doc_id for r in Q.judge(docs).where("kept").collect()} == {i for i, h, f in rows if not f and h not in falls}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.judge(docs).count() == 0 and Q.keep(docs).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows, Q.op8(spark, sf_dir).collect())


def test_keep_writes_no_texts(spark):
    """Hosts' counts are all that is written, so the disk holds no second copy of the texts."""
    import os

    from vellum.llm import quality_rules
    from vellum.llm.common import scratch_dir

    texts = [" ".join(f"w{j % (5 + 2 * k)}" for j in range(40 + k)) for k in range(60)] + [None, "", "same same same " * 40]
    docs = spark.createDataFrame([(k, t, f"h{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    at = f"{scratch_dir(spark)}/vellum".removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    kept = sorted(r.doc_id for r in quality_rules.keep(docs).collect())
    made = [spark.read.parquet(f"{at}/{x}").columns for x in set(os.listdir(at)) - before]
    assert made and not any("text" in columns for columns in made)
    assert kept == sorted(r.doc_id for r in quality_rules.judge(docs).where("kept").collect()) and 0 < len(kept) < len(texts)
    rules = docs.select(quality_rules.rule_counts(docs["text"])["failed"].alias("a"), quality_rules.rule_failed(docs["text"]).alias("b"))
    assert all(r.a == r.b for r in rules.collect())
