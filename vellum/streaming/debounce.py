"""Change events: filters, and a debounce that counts from the last accepted event of a page."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WINDOW_S = 900
TRIGGERS = ("page_updated", "page_created", "page_restored")


def triggering(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(*TRIGGERS) & F.col("page_id").cast("string").rlike("^[0-9]+$"))


def debounced(events: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    """Events accepted a page: the first, and each at least ``seconds`` after the last accepted one.

    The rule is sequential, so a page's events lie in one partition, sorted by time, and are read past one at a
    time: what is held is a batch and the last accepted time, however many events a page has."""
    rows = events.select("page_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    kinds = dict(rows.dtypes)

    def accept(batches):
        page, last = object(), 0
        for batch in batches:
            pages, ids = [], []
            for p, us, i in zip(*(batch.column(c).to_pylist() for c in ("page_id", "us", "event_id")), strict=True):
                if p != page or us - last >= seconds * 1_000_000:
                    page, last = p, us
                    pages.append(p)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(pages, batch.column("page_id").type), pa.array(ids, batch.column("event_id").type)], names=["page_id", "event_id"])

    return rows.repartition("page_id").sortWithinPartitions("page_id", "us", "event_id").mapInArrow(accept, f"page_id {kinds['page_id']}, event_id {kinds['event_id']}")


def debounced_stream(events: DataFrame, seconds: int = WINDOW_S, late: str = "1 hour") -> DataFrame:
    """The same over a stream: one time of state a page, dropped once the watermark has passed it."""

    def accept(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        taken = []
        for us, i in zip(rows["us"].tolist(), rows["event_id"].tolist(), strict=True):
            if last is None or us - last >= seconds * 1_000_000:
                last = us
                taken.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"page_id": [key[0]] * len(taken), "event_id": taken})

    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))  # pandas times would be the session zone's
    return timed.groupBy("page_id").applyInPandasWithState(accept, "page_id long, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
