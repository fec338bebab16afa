import corpus_pipeline as C
from test_near_copies import brute_kept

from vellum.llm import decontamination, quality_rules, sharding


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = C.keep_good(spark, docs, sf_dir)
    assert good.columns == docs.columns and ids(good) == ids(quality_rules.judge(docs).where("kept"))
    single = C.keep_one_of_each(spark, good, sf_dir)
    assert single.columns == docs.columns and ids(single) == brute_kept([(r.doc_id, r.text) for r in good.collect()])[0]
    clean = C.remove_leaks(spark, single, sf_dir)
    leaks = {r.doc_id for r in decontamination.leaks(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(clean) == sorted(set(ids(single)) - leaks)
    assert C.mix(spark, clean, sf_dir).columns == docs.columns


def test_run(spark, sf_dir):
    rows = C.run(spark, sf_dir)
    got = rows.collect()
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "shard"] and got
    assert all(len(r.text.encode()) + sharding.OVERHEAD == r.size for r in got)
