"""Queries on streams: each runs a stream over all events to its end and returns what it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans.logical import duck, logical
from vellum.plans.queries import ORACLE, QUERIES, query
from vellum.sources.scratch import new_folder
from vellum.streaming import ingest, windows


def _stream(events, parts: int = 4):
    """The events as a stream that takes a file at a time."""
    spark, path = events.sparkSession, new_folder(events.sparkSession, "events")
    events.repartitionByRange(parts, "ts").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def by_lines(pages):
    lines = F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text")
    return pages.select("source_id", "version", lines)


def stream_ingest(spark, sf_dir):
    """All change events through the stream: a page is fetched at its first event, its later ones find the version known."""

    def pages(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"), F.col("doc_id").alias("page_id"), (F.col("doc_id") % 3).cast("string").alias("version"), "text")

    store = new_folder(spark, "store")
    ingest.start(_stream(logical(spark, sf_dir, "webhook_events")), pages, store, by_lines, availableNow=True).awaitTermination()
    return ingest.current(spark, store)


QUERIES["stream_ingest"] = stream_ingest
ORACLE["stream_ingest"] = duck(
    """SELECT source_id, source_version AS version, chunk_index, chunk_text FROM prd_chunks WHERE doc_id IN (SELECT page_id FROM webhook_events WHERE event IN ('page_updated', 'page_created', 'page_restored'))""",
    "prd_chunks", "webhook_events",
)


@query("runs_in_flight", "webhook_events", sql="SELECT DISTINCT sha256(page_id::VARCHAR || '|' || event || '|' || strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00+00:00')) AS run_id, page_id, event FROM webhook_events")
def runs_in_flight(e):
    """Requests of one kind within a minute are one run; a duplicate is at most a minute behind, so every one is found. The landed files
    come in no order of time, so none of their span may count as late."""
    requests = e.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _stream(requests).withColumn("run_id", windows.run_identity(F.col("page_id"), F.col("event"), at=F.col("ts")))
    out = new_folder(e.sparkSession, "in-flight")
    span = requests.agg(F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).first()[0] or 0
    kept = windows.one_in_flight(stream, f"{span + 60} seconds").select("run_id", "page_id", "event")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(e.sparkSession, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return e.sparkSession.read.schema(kept.schema).parquet(out)


@query("event_sessions", "webhook_events", sql="""WITH g AS (SELECT page_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY page_id ORDER BY epoch_us(ts)) <= 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS begins FROM webhook_events),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY page_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT page_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY page_id, no""")
def event_sessions(e):
    found = windows.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "page_id")
    return found.select("page_id", F.unix_micros("session_start").alias("first_us"), F.unix_micros("last_event").alias("last_us"), "n")


@query("event_windows", "webhook_events", sql="SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event, count(*) AS n FROM webhook_events GROUP BY ALL")
def event_windows(e):
    found = windows.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event")
    return found.select(F.unix_micros("window_start").alias("start_us"), "event", "n")
