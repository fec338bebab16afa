"""Incremental ingest as a stream: change events in, chunks of changed pages out, each micro-batch once.

A store is a folder that one stream owns, its checkpoint included:

    <store>/checkpoint            the stream's own
    <store>/chunks/batch=<id>     chunks of the sources that the batch fetched
    <store>/sources/batch=<id>    those sources: version and number of chunks
    <store>/ledger/batch=<id>     one row of counts; a batch counts once this is written, which is last

A batch that fails on the way is replayed under the same id and overwrites what it had written; one that is in the ledger
already changes nothing. Readers take committed batches only, and of each source the chunks of the last one (replacement by
source), so a batch costs what it changed, not what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.chunking import chunk_table
from vellum.operators.sync import to_fetch
from vellum.sources.scratch import exists
from vellum.streaming.debounce import triggering

SOURCES = "source_id string, version string, n_chunks long"
LEDGER = "n_events long, n_pages long, n_fetched long, n_unchanged long, n_missing long, n_chunks long"


def batches_done(spark: SparkSession, store: str) -> list[int]:
    """Ids of the committed batches."""
    if not exists(spark, f"{store}/ledger"):
        return []
    return sorted(r.batch for r in spark.read.schema(f"{LEDGER}, batch int").parquet(f"{store}/ledger").select("batch").distinct().collect())


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """A row of counts a committed batch."""
    return spark.read.schema(f"{LEDGER}, batch int").parquet(f"{store}/ledger")


def _committed(spark: SparkSession, store: str, kind: str, schema: str) -> DataFrame:
    done = batches_done(spark, store)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.option("basePath", f"{store}/{kind}").schema(f"{schema}, batch int").parquet(*[f"{store}/{kind}/batch={b}" for b in done])


def indexed(spark: SparkSession, store: str) -> DataFrame:
    """``source_id, version, n_chunks, batch``: each source as its last committed batch left it."""
    rows = _committed(spark, store, "sources", SOURCES)
    return rows.groupBy("source_id").agg(F.max_by(F.struct("version", "n_chunks", "batch"), "batch").alias("x")).select("source_id", "x.*")


def current(spark: SparkSession, store: str, schema: str = "source_id string, version string, chunk_index int, chunk_text string") -> DataFrame:
    """The chunks that the store holds now."""
    return _committed(spark, store, "chunks", schema).join(indexed(spark, store).select("source_id", "batch"), ["source_id", "batch"], "left_semi").drop("batch")


def sectioned(pages: DataFrame) -> DataFrame:
    """Chunks of pages (``source_id, version, text``) by their sections."""
    chunks = chunk_table(pages, "source_id", "text").join(pages.select("source_id", "version"), "source_id")
    return chunks.select("source_id", "version", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text")


def ingest_batch(events: DataFrame, batch: int, pages: Callable[[SparkSession], DataFrame], store: str, chunk: Callable[[DataFrame], DataFrame] = sectioned) -> None:
    """One micro-batch: the pages of its events whose live version is not the indexed one are chunked and replaced.

    ``pages`` gives the wiki as it is now: ``source_id, page_id, version, text``. A page that is gone keeps its chunks."""
    spark = events.sparkSession
    if batch in batches_done(spark, store):
        return
    asked = triggering(events)
    wanted = asked.select(F.col("page_id").cast("string").alias("page_id")).distinct()
    live = pages(spark).withColumn("page_id", F.col("page_id").cast("string")).join(wanted, "page_id", "left_semi")
    known = indexed(spark, store).select("source_id", "version")
    fetch = to_fetch(live.select("source_id", F.col("version").cast("string").alias("live_version")), known).where("fetch").select("source_id")
    new = live.join(fetch, "source_id", "left_semi").select("source_id", F.col("version").cast("string").alias("version"), "text")
    chunk(new).write.mode("overwrite").parquet(f"{store}/chunks/batch={batch}")
    made = spark.read.parquet(f"{store}/chunks/batch={batch}").groupBy("source_id").agg(F.count("*").alias("n"))
    sources = new.select("source_id", "version").join(made, "source_id", "left").select("source_id", "version", F.coalesce("n", F.lit(0)).alias("n_chunks"))
    sources.write.mode("overwrite").parquet(f"{store}/sources/batch={batch}")
    fetched = spark.read.schema(SOURCES).parquet(f"{store}/sources/batch={batch}").agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
    n_events, n_pages, n_live = events.count(), wanted.count(), live.count()
    counts = (n_events, n_pages, fetched[0], n_live - fetched[0], n_pages - n_live, fetched[1])
    commit(spark.createDataFrame([counts], LEDGER), store, batch)


def commit(counts: DataFrame, store: str, batch: int) -> None:
    counts.coalesce(1).write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}")


def start(events: DataFrame, pages: Callable[[SparkSession], DataFrame], store: str, chunk: Callable[[DataFrame], DataFrame] = sectioned, **trigger) -> StreamingQuery:
    """Starts (or goes on with) the stream of a store over ``events`` (``event_id, ts, page_id, event``)."""
    writer = events.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, pages, store, chunk)).option("checkpointLocation", f"{store}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
