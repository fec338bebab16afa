"""Paged listings (spaces, pages, tests, attachments) as a Spark data source, with retries and typed failures.

A listing is landed as one folder a page, ``listing=<key>/page=<n>/``, whose files hold the answers to the successive
attempts, a JSON line each: ``{"status": 200, "body": {"results": [...], "next": <page or null>}}`` or ``{"status": 503, "error":
"..."}``. ``land`` writes such folders from a table. A partition of the source is ``pages_per_task`` pages, read in tasks; a page
that fails gives one failure row and stops nothing else.

    spark.dataSource.register(PagedListing)
    spark.read.format("paged_listing").option("mode", "items").load(path).where("status = 'current'")

Options: ``mode`` (``items``, or ``failures`` for one row a failed page), ``include_personal`` (keys with ``~``; off), ``keys`` (comma-separated, any
case; all), ``title_filter`` (part of a title, any case), ``pages_per_task`` (8), ``max_items`` a page (none), ``wait`` (seconds that the waits between
attempts are multiplied by; 0 for landed pages). Filters that compare ``listing`` or ``status`` to values are taken by the source:
keys prune folders before any is read, the others drop rows where they are parsed."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: The waits before each attempt, and what a message holds that is worth another one.
DELAYS = (0.0, 1.0, 2.0, 4.0)
RETRYABLE = ("429", "502", "503", "504", "timeout", "temporarily", "rate", "connection reset", "connection aborted", "broken pipe")

ITEM = "listing string, page int, item_no int, id string, title string, version int, status string, attempts int"
FAILURE = "listing string, page int, attempts int, outcome string, error string"


class Outcome(NamedTuple):
    """What came of a call: ``kind`` is ok, exhausted (worth another attempt, but there is none) or permanent."""

    value: object
    attempts: int
    kind: str
    error: str | None


def is_retryable(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.greatest(*[F.contains(low, F.lit(s)) for s in RETRYABLE])


def with_retry(call: Callable[[int], object], delays: tuple[float, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Calls with the number of the attempt (from 0) until it returns, fails for good, or the attempts are used up."""
    error = ""
    for attempt, delay in enumerate(delays):
        if delay:
            sleep(delay)
        try:
            return Outcome(call(attempt), attempt + 1, "ok", None)
        except Exception as e:
            error = str(e) or type(e).__name__
            if not (isinstance(e, TimeoutError) or any(s in error.lower() for s in RETRYABLE)):
                return Outcome(None, attempt + 1, "permanent", error)
    return Outcome(None, len(delays), "exhausted", error)


def _file_system(path: str):
    """The file system of a folder that all machines reach, and the folder's path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


class _Pages(InputPartition):
    def __init__(self, pages: list[tuple[str, int, str]]) -> None:
        super().__init__(pages)
        self.pages = pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], failures: bool) -> None:
        self.path, self.failures = options["path"], failures
        self.personal = options.get("include_personal", "false").lower() == "true"
        self.keys = {k.strip().upper() for k in options.get("keys", "").split(",") if k.strip()}
        self.title, self.each = options.get("title_filter", "").lower(), max(1, int(options.get("pages_per_task", "8")))
        self.most, self.wait = int(options["max_items"]) if "max_items" in options else None, float(options.get("wait", "0"))
        self.listings: set | None = None
        self.statuses: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("listing",):
                self.listings = values if self.listings is None else self.listings & values
            elif values is not None and f.attribute == ("status",) and not self.failures:
                self.statuses = values if self.statuses is None else self.statuses & values
            else:
                yield f

    def partitions(self) -> list[_Pages]:
        from pyarrow import fs

        store, root = _file_system(self.path)
        pages = []
        for folder in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if not (found := re.search(r"listing=([^/]*)$", folder.path)):
                continue
            key = unquote(found[1])
            if (key.startswith("~") and not self.personal) or (self.keys and key.upper() not in self.keys) or (self.listings is not None and key not in self.listings):
                continue
            pages += [(key, int(m[1]), page.path) for page in store.get_file_info(fs.FileSelector(folder.path)) if (m := re.search(r"page=(\d+)$", page.path))]
        pages.sort()
        return [_Pages(pages[k : k + self.each]) for k in range(0, len(pages), self.each)] or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        store, _ = _file_system(self.path)
        for key, page, folder in partition.pages:
            answers = _answers(store, folder)
            got = with_retry(lambda k, answers=answers: _body(answers, k), sleep=lambda s: time.sleep(s * self.wait))
            if self.failures:
                if got.kind != "ok":
                    yield key, page, got.attempts, got.kind, got.error
                continue
            for no, item in enumerate((got.value or [])[: self.most]):
                title, status = item.get("title") or "", item.get("status") or "current"
                if (self.title in title.lower()) and (self.statuses is None or status in self.statuses):
                    yield key, page, no, str(item["id"]), title, int((item.get("version") or {}).get("number", 1)), status, got.attempts


def _answers(store, folder: str) -> list[str]:
    from pyarrow import fs

    lines: list[str] = []
    for f in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if f.is_file and not f.base_name.startswith((".", "_")):
            with store.open_input_stream(f.path, compression=None) as stream:
                lines += stream.read().decode("utf-8", "replace").split("\n")
    return [x for x in lines if x.strip()]


def _body(answers: list[str], attempt: int) -> list[dict]:
    """Items of the answer to an attempt; an error by its status, or as malformed."""
    if not answers:
        raise ValueError("malformed: no answer")
    try:
        answer = json.loads(answers[min(attempt, len(answers) - 1)])
    except json.JSONDecodeError:
        raise ValueError("malformed: no JSON") from None
    if answer.get("status") != 200:
        raise RuntimeError(f"{answer.get('status')} {answer.get('error') or ''}".strip())
    results = (answer.get("body") or {}).get("results")
    if not isinstance(results, list) or not all(isinstance(x, dict) and x.get("id") is not None for x in results):
        raise ValueError("malformed: no results")
    return results


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def _failures(self) -> bool:
        return self.options.get("mode", "items") == "failures"

    def schema(self) -> str:
        return FAILURE if self._failures() else ITEM

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._failures())


def land(items: DataFrame, path: str, answers: Column | None = None) -> None:
    """Writes a table of items (``listing, page, id, title, version, status``) as landed pages, a page a folder.

    ``answers``, an array of text over ``listing, page, ok`` (the good answer as JSON), says what each page's successive attempts got."""
    item = F.struct("id", "title", F.struct(F.col("version").alias("number")).alias("version"), "status")
    pages = items.groupBy("listing", "page").agg(F.array_sort(F.collect_list(item)).alias("results"))  # a page is bounded by its source
    body = F.struct(F.lit(200).alias("status"), F.struct("results").alias("body"))
    lines = pages.select("listing", "page", F.to_json(body).alias("ok"))
    lines = lines.select("listing", "page", F.array_join(F.array("ok") if answers is None else answers, "\n").alias("value"))
    lines.repartition("listing", "page").write.partitionBy("listing", "page").text(path)


def first_seen(rows: DataFrame, key: str = "id") -> DataFrame:
    """Each key's first row, in the order of listings, pages and places on a page."""
    w = Window.partitionBy(key).orderBy("listing", "page", "item_no")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def register(spark) -> None:
    """Opens the source to ``spark.read.format("paged_listing")``, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedListing)
