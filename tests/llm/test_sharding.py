import zlib
from collections import Counter

from vellum.llm.sharding import add_shards, assign, op9


def check(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = {s: sum(r.size for r in part) for s, part in by.items()}
    largest, target = max(r.size for r in got), sum(sizes.values()) / shards
    assert all(sizes.get(s, 0) <= target * 1.05 + 2 * largest and sizes.get(s, 0) >= target * 0.95 - 2 * largest for s in range(shards))


def test_small_cases(spark):
    rows = [(None, "x"), (0, None), (1, ""), (2, "é" * 500)] + [(k, f"text {k} " * (k % 9)) for k in range(3, 400)] + [(k, "copy " * 20) for k in range(400, 700)] + [(7, "again")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as shard", "8 as part", "7 as first")
    check(rows, assign(docs, 8).collect(), 8)
    docs = docs.selectExpr("*", "1 as placed_text", "2 as copy_no", "3 as copy", "4 as placed_id", "5 as own_key", "6 as slot")
    whole = add_shards(docs, 8)
    assert whole.columns == ["doc_id", "text", "part", "first", "placed_text", "copy_no", "copy", "placed_id", "own_key", "slot", "size", "text_crc32", "shard"]
    got = whole.collect()
    assert all(tuple(r)[2:10] == (8, 7, 1, 2, 3, 4, 5, 6) for r in got)
    same(got, assign(docs, 8).collect())


def same(got, placed):
    """Rows with a key of their own have the shard that ``assign`` found."""
    count = lambda rows: Counter((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in rows)
    assert count(got) == count(placed)


def test_repeated_rows_on_both_sides_of_a_cut(spark):
    rows = [(1, "the same row " * 10)] * 4000 + [(k, f"text {k}") for k in range(2, 200)] + [(500, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = add_shards(docs, 10).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    placed = Counter()
    for r in assign(docs, 10).collect():
        placed[r.shard] += r.size
    assert all(abs(sizes[s] - placed[s]) < 0.2 * sum(placed.values()) / 10 for s in placed)


def test_small_groups_stay_together(spark):
    rows = [(2 * k + j, f"text {k} " * 5) for k in range(3000) for j in (0, 1)]
    got = assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[2 * k] == shard[2 * k + 1] for k in range(3000))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert assign(docs).count() == 0 and add_shards(docs).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op9(spark, sf_dir).collect()
    check(rows, got, 40)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
