from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.plans.stream_queries import by_lines
from vellum.streaming import ingest, windows

T0 = datetime(2024, 5, 1, 12)
EVENTS = "event_id long, ts timestamp, page_id long, event string"


def files(spark, path, *batches):
    """One file a batch, in the order of their times."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def wiki(spark, pages):
    return lambda _: spark.createDataFrame([(f"doc:{p}", p, v, t) for p, (v, t) in pages.items()], "source_id string, page_id long, version int, text string")


def held(spark, store):
    return sorted((r.source_id, r.version, r.chunk_index, r.chunk_text) for r in ingest.current(spark, store).collect())


def update(no, page, event="page_updated"):
    return (no, T0 + timedelta(minutes=no), page, event)


PAGES = {1: (1, "a\nb"), 2: (1, "c"), 3: (4, ""), 4: (1, "never asked")}
BATCHES = [[update(1, 1), update(2, 2), update(3, 1)], [update(4, 3), update(5, 9), update(6, 4, "page_viewed")], [update(7, 2, "page_restored"), update(8, 1)]]
WANTED = [("doc:1", "1", 0, "a"), ("doc:1", "1", 1, "b"), ("doc:2", "1", 0, "c"), ("doc:3", "4", 0, "")]


@pytest.mark.parametrize("where", ["before", "chunks", "commit"])
def test_a_killed_stream_goes_on(spark, tmp_path, monkeypatch, where):
    """The second batch dies before, while or after its chunks are written; after a restart all is as if it hadn't."""
    stream, store = files(spark, str(tmp_path / "in"), *BATCHES), str(tmp_path / "store")
    state = {"dies": True}

    def pages(spark):
        if where == "before" and state["dies"] and len(ingest.batches_done(spark, store)) == 1:
            raise RuntimeError("killed")
        return wiki(spark, PAGES)(spark)

    def chunk(rows):
        if where == "chunks" and state["dies"] and len(ingest.batches_done(spark, store)) == 1:
            return by_lines(rows).withColumn("chunk_index", F.raise_error(F.lit("killed")).cast("int"))
        return by_lines(rows)

    real = ingest.commit

    def commit(counts, at, batch):
        if where == "commit" and state["dies"] and batch == 1:
            raise RuntimeError("killed")
        real(counts, at, batch)

    monkeypatch.setattr(ingest, "commit", commit)
    with pytest.raises(Exception, match="killed"):
        ingest.start(stream(), pages, store, chunk, availableNow=True).awaitTermination()
    assert ingest.batches_done(spark, store) == [0] and held(spark, store) == [w for w in WANTED if w[0] != "doc:3"]
    state["dies"] = False
    ingest.start(stream(), pages, store, chunk, availableNow=True).awaitTermination()
    assert held(spark, store) == WANTED and ingest.batches_done(spark, store) == [0, 1, 2]
    counts = {r.batch: tuple(r[c] for c in ("n_events", "n_pages", "n_fetched", "n_unchanged", "n_missing", "n_chunks")) for r in ingest.ledger(spark, store).collect()}
    assert counts == {0: (3, 2, 2, 0, 0, 3), 1: (3, 2, 1, 0, 1, 1), 2: (2, 2, 0, 2, 0, 0)}


def test_replays_and_new_versions(spark, tmp_path):
    store, events = str(tmp_path / "store"), spark.createDataFrame([update(1, 1), update(2, 2)], EVENTS)
    ingest.ingest_batch(events, 0, wiki(spark, PAGES), store, by_lines)
    before = held(spark, store)
    ingest.ingest_batch(events, 0, wiki(spark, {1: (9, "other")}), store, by_lines)  # the same batch again
    assert held(spark, store) == before
    ingest.ingest_batch(events, 1, wiki(spark, {1: (2, "x"), 2: (1, "unseen, as the version is the same")}), store, by_lines)
    assert held(spark, store) == [("doc:1", "2", 0, "x"), ("doc:2", "1", 0, "c")]
    ingest.ingest_batch(events.limit(0), 2, wiki(spark, PAGES), store, by_lines)
    assert held(spark, store) == [("doc:1", "2", 0, "x"), ("doc:2", "1", 0, "c")]


def test_sections_through_the_stream(spark, tmp_path):
    text = "# Title\n\nFirst words of a section here.\n\n## Next\n\nMore words of another section.\n"
    ingest.ingest_batch(spark.createDataFrame([update(1, 1)], EVENTS), 0, wiki(spark, {1: (1, text)}), str(tmp_path / "s"))
    assert [r[2] for r in held(spark, str(tmp_path / "s"))] == [0, 1]


def run(frame, spark, path, mode="append"):
    query = frame.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.read.schema(frame.schema).parquet(f"{path}/out")


def test_runs_in_flight_and_late_rows(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), [update(1, 1), update(2, 1), update(3, 2)], [update(4, 1), update(200, 3)], [update(203, 4)], [update(5, 7), update(201, 1), update(202, 3)])
    requests = stream().withColumn("run_id", F.col("page_id").cast("string"))
    query, out = run(windows.one_in_flight(requests), spark, tmp_path)
    assert sorted((r.run_id, r.event_id) for r in out.collect() if r.run_id != "1") == [("2", 3), ("3", 200), ("4", 203)]
    assert sorted(r.event_id for r in out.where("run_id = '1'").collect()) == [1, 201]  # 1 is no longer remembered after an hour
    assert windows.late_rows(query) == 1  # event 5 lies behind the watermark


def test_sessions_and_windows_of_a_stream(spark, tmp_path):
    rows = [update(0, 1), update(10, 1), update(50, 1), update(60, 2), update(95, 1), update(130, 2)]
    end = [update(10_000, 99)]
    batch = spark.createDataFrame(rows, EVENTS)
    for name, f in (("s", lambda e: windows.sessions(e, "30 minutes", "page_id")), ("w", lambda e: windows.tumbling(e, "1 hour", "event"))):
        stream = files(spark, str(tmp_path / f"{name}-in"), rows[:3], rows[3:], end, [update(10_001, 99)])
        _, out = run(f(stream()), spark, tmp_path / name)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, f(batch).collect())), name
