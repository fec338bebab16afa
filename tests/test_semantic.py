import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import chunking, semantic
from vellum.plans.queries import QUERIES

SEGMENTS = "source_id string, section_no int, seg_no int, heading string, kind string, text string, n_tokens int, embedding array<double>"


def cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return round(float(np.dot(a, b) / (na * nb)), 6) if na * nb >= 1e-16 else 0.0


def brute(segments, least=100, most=1200, share=30):
    """Sections one by one: similarities, threshold, cuts, merging."""
    out, sections = [], defaultdict(list)
    for s in segments:
        sections[s[0], s[1]].append(s)
    index = defaultdict(int)
    for (source, no), rows in sorted(sections.items()):
        rows.sort(key=lambda r: r[2])
        prose = lambda k, rows=rows: rows[k][4] == "prose"
        sims = [1.0] + [cosine(rows[k - 1][7], rows[k][7]) if prose(k) and prose(k - 1) else 1.0 for k in range(1, len(rows))]
        below = [x for x in sims if x < 1]
        threshold = round(float(np.percentile(below, share)), 6) if below else -1.0
        groups = [[rows[0]]]
        whole = len(rows) <= 2 or sum(r[6] for r in rows) <= least
        for k in range(1, len(rows)):
            size = sum(r[6] for r in groups[-1])
            if not whole and ((sims[k] < threshold and size >= least) or size + rows[k][6] > most):
                groups.append([rows[k]])
            else:
                groups[-1].append(rows[k])
        merged = []
        for g in groups:
            if merged and sum(r[6] for r in g) < least:
                merged[-1] += g
            else:
                merged.append(list(g))
        for c, g in enumerate(merged):
            text = g[0][5]
            for a, b in zip(g[:-1], g[1:], strict=True):
                text += (" " if a[4] == b[4] == "prose" else "\n") + b[5]
            kinds = {r[4] for r in g}
            out.append((source, no, c, index[source], g[0][3], text, kinds.pop() if len(kinds) == 1 else "mixed", sum(r[6] for r in g)))
            index[source] += 1
    return sorted(out)


def held(chunks):
    return sorted((r.source_id, r.section_no, r.chunk_no, r.chunk_index, r.heading, r.chunk_text, r.chunk_type, r.n_tokens) for r in chunks.collect())


def test_random_sections_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for d in range(12):
        for s in range(3):
            for k in range(rng.choice([1, 2, 3, 9, 40])):
                kind = rng.choice(["prose"] * 5 + ["table", "code"])
                vector = [0.0] * 3 if rng.random() < 0.1 else [float(rng.randrange(-3, 4)) for _ in range(3)]
                rows.append((f"d{d}", s, k, f"h{s}", kind, f"{kind}{k}", rng.choice([3, 20, 60, 150, 1300]), vector))
    frame = spark.createDataFrame(rows, SEGMENTS)
    assert held(semantic.semantic_chunks(frame)) == brute(rows)
    assert held(semantic.semantic_chunks(frame, 50, 300, 0.5)) == brute(rows, 50, 300, 50)
    assert held(semantic.semantic_chunks(frame.limit(0))) == []
    none = frame.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert semantic.semantic_groups(none).count() == len(rows)


def test_whole_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in semantic.segment_table(docs, "doc_id").withColumn("embedding", chunking.hashed_vector(F.col("text"))).collect()]
    got = held(QUERIES["semantic_chunks"](spark, sf_dir))
    assert got == brute(rows) and max(r[2] for r in got) > 3


def test_sql_table_function_equals_the_dataframe_way(spark, sf_dir):
    lateral = QUERIES["chunks_lateral"](spark, sf_dir).drop("n_tokens")
    plain = QUERIES["chunk_fixed"](spark, sf_dir).select(lateral.columns)
    assert sorted(map(tuple, lateral.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_scalar_sql_functions(spark):
    from vellum.functions import text as T
    from vellum.functions.sql import register

    register(spark)
    rows = spark.createDataFrame([("2.1) Payment  Capture:", " High "), ("https://x/pages/12/y", "sure"), ("77", None), (None, "LOW"), ("It's a \\ PRD", "medium")], "t string, c string")
    pairs = [("vellum_heading(t)", T.normalized_heading(F.col("t"))), ("vellum_confidence(c)", T.confidence(F.col("c"))), ("vellum_doc_type(t)", T.doc_type(F.col("t"))), ("vellum_token_count(t)", T.token_count(F.col("t")))]
    for sql, column in pairs:
        got = rows.select(F.expr(sql).alias("a"), column.alias("b")).where("t IS NOT NULL").collect()
        assert all(r.a == r.b for r in got), sql
    assert [r[0] for r in rows.select(F.expr("vellum_page_id(t)")).collect()] == ["", "12", "77", None, ""]
