import json
import re

import pytest
from pyspark.sql import functions as F

from vellum.sources import listings as L


def page(root, listing, number, *answers):
    folder = root / f"listing={listing}" / f"page={number}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text("\n".join(a if isinstance(a, str) else json.dumps(a) for a in answers))


def good(*items):
    return {"status": 200, "body": {"results": [{"id": i, "title": t, "version": {"number": v}, "status": s} for i, t, v, s in items]}}


@pytest.fixture
def landed(spark, tmp_path):
    page(tmp_path, "DOCS", 0, good((1, "Plan A", 3, "current"), (2, "Notes", 1, "archived")))
    page(tmp_path, "DOCS", 1, {"status": 429, "error": "slow down"}, {"status": 503}, good((1, "Plan A again", 4, "current"), (5, "plan b", 1, "current")))
    page(tmp_path, "DOCS", 2, {"status": 500, "error": "Temporarily out"})
    page(tmp_path, "DOCS", 3, '{"status": 200, "body": {"results": [{"id"')
    page(tmp_path, "DOCS", 4, {"status": 404, "error": "Not found"}, good((9, "never seen", 1, "current")))
    page(tmp_path, "DOCS", 5, {"status": 200, "body": {"results": [{"title": "no id"}]}})
    page(tmp_path, "DOCS", 6)
    page(tmp_path, "DOCS", 7, {"status": 200, "body": {"results": [{"id": "x7", "title": None}]}})
    page(tmp_path, "%7Eme", 0, good((7, "Draft plan", 1, "current")))
    page(tmp_path, "OPS", 0, good())
    L.register(spark)
    return lambda mode="items", **options: spark.read.format("paged_listing").option("mode", mode).options(**options).load(str(tmp_path))


def test_items_and_failures(landed):
    rows = {(r.listing, r.page, r.item_no): (r.id, r.version, r.attempts) for r in landed().collect()}
    assert rows == {("DOCS", 0, 0): ("1", 3, 1), ("DOCS", 0, 1): ("2", 1, 1), ("DOCS", 1, 0): ("1", 4, 3), ("DOCS", 1, 1): ("5", 1, 3), ("DOCS", 7, 0): ("x7", 1, 1)}
    bad = {r.page: (r.attempts, r.outcome, r.error) for r in landed("failures").collect()}
    assert bad == {
        2: (4, "exhausted", "500 Temporarily out"), 3: (1, "permanent", "malformed: no JSON"), 4: (1, "permanent", "404 Not found"),
        5: (1, "permanent", "malformed: no results"), 6: (1, "permanent", "malformed: no answer"),
    }


def test_options_and_first_seen(landed):
    assert {r.id for r in landed(title_filter="PLAN", include_personal="true", pages_per_task="1").collect()} == {"1", "5", "7"}
    assert {r.id for r in landed(keys=" docs , none").collect()} == {"1", "2", "5", "x7"} and landed(keys="none").count() == 0
    assert {r.id for r in landed(max_items="1").collect()} == {"1", "x7"}
    assert {(r.id, r.version) for r in L.first_seen(landed()).collect()} == {("1", 3), ("2", 1), ("5", 1), ("x7", 1)}


def test_filters_are_pushed(landed, capsys):
    rows = landed(include_personal="true").where("status = 'current' AND listing IN ('~me', 'OPS') AND version > 0")
    assert [r.id for r in rows.collect()] == ["7"]
    rows.explain()
    plan = capsys.readouterr().out
    left = plan.split("Filter")[1].split("\n")[0]
    assert not re.search(r"(status|listing)#\d+ (=|IN)", left) and re.search(r"version#\d+ >", left)
    reader = L._Reader({"path": "x"}, failures=True)
    kept = list(reader.pushFilters([L.EqualTo(("status",), "a"), L.EqualTo(("listing",), "D"), L.In(("listing",), ("D", "E"))]))
    assert len(kept) == 1 and reader.listings == {"D"}


def test_landed_table_comes_back(spark, tmp_path):
    rows = [(f"S {k % 3}/~", k // 10, str(k), f"Title {k} é\"\n", k, "current") for k in range(60)] + [(None, 0, "n", None, None, None)]
    items = spark.createDataFrame(rows, "listing string, page int, id string, title string, version int, status string")
    L.land(items.where("listing IS NOT NULL"), str(tmp_path / "x"))
    got = spark.read.format("paged_listing").load(str(tmp_path / "x")).collect()
    assert {(r.listing, r.page, r.id, r.title, r.version, r.status) for r in got} == set(rows[:-1])
    L.land(items.limit(0), str(tmp_path / "none"))
    assert spark.read.format("paged_listing").load(str(tmp_path / "none")).count() == 0


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fails(k):
        calls.append(k)
        raise RuntimeError("Connection reset by peer")

    assert L.with_retry(fails, sleep=waits.append) == (None, 4, "exhausted", "Connection reset by peer") and waits == [1.0, 2.0, 4.0] and calls == [0, 1, 2, 3]
    assert L.with_retry(lambda k: 5 if k else (_ for _ in ()).throw(TimeoutError()), sleep=waits.append) == (5, 2, "ok", None)
    assert L.with_retry(lambda k: int("x"), sleep=waits.append).kind == "permanent"


def test_retryable_as_a_column(spark):
    rows = spark.createDataFrame([("HTTP 429",), ("Rate limited",), ("gone",), (None,)], "m string").select(L.is_retryable(F.col("m"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False]
