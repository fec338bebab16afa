"""Runs in flight and windows over events; each works on a table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_identity(*parts: Column, at: Column) -> Column:
    """One identity for all requests of the same kind within a minute."""
    minute = F.date_format(F.date_trunc("minute", at), "yyyy-MM-dd'T'HH:mm:00+00:00")
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts], minute), 256)


def one_in_flight(requests: DataFrame, within: str = "1 hour", key: str = "run_id", at: str = "ts") -> DataFrame:
    """A stream of requests without those whose ``key`` came before and may still run: state is one key, kept for
    ``within`` of event time. Later than that behind the newest event, a request is late and dropped."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events a window of fixed width (and key): ``window_start, <keys>, n``."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events of each key in runs without a pause of ``gap``: ``<keys>, session_start, last_event, n``."""
    counts = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"), F.max(at).alias("last_event"))
    return counts.select(*keys, F.col("session_window.start").alias("session_start"), "last_event", "n")


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's stateful steps have dropped as too late, over the progress it remembers."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
