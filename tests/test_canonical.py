import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import canonical as C
from vellum.plans.logical import logical
from vellum.plans.queries import QUERIES

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=40))
def test_canonical_json_is_pythons(spark, values):
    rows = [(k, json.dumps(v, ensure_ascii=k % 2 == 0, indent=k % 3 or None)) for k, v in enumerate(values)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, t string").select("k", C.canonical_json(F.col("t")).alias("c")).collect()}
    assert got == {k: json.dumps(v, sort_keys=True, separators=(",", ":")) for k, v in enumerate(values)}


def test_what_is_no_json(spark):
    rows = spark.createDataFrame([("{",), (None,), ("",), ('{"b":1,"a":{"d":"é","c":1.50}}',), ("[" * 100_000,)], "t string")
    assert [r[0] for r in rows.select(C.canonical_json(F.col("t"))).collect()] == [None, None, None, '{"a":{"c":1.5,"d":"\\u00e9"},"b":1}', None]


def test_chains_tell_every_change(spark):
    rows = [(run, n, json.dumps({"n": n})) for run in ("a", "b") for n in range(5)] + [("c", 1, "{}")]
    ledger = C.chained(spark.createDataFrame(rows, "run string, n int, entry string"), "run", "n", "entry").cache()
    for run in ("a", "c"):
        last = ""
        for r in ledger.where(F.col("run") == run).orderBy("n").collect():
            assert r.previous == last and r.hash == hashlib.sha256((last + r.entry).encode()).hexdigest()
            last = r.hash
    broken = lambda t: {(r.run, r.n) for r in C.broken_links(t, "run", "n", "entry").collect()}
    assert broken(ledger) == set()
    assert broken(ledger.withColumn("entry", F.when((F.col("run") == "a") & (F.col("n") == 2), "{}").otherwise(F.col("entry")))) == {("a", 2)}
    assert broken(ledger.where("run <> 'b' OR n <> 3")) == {("b", 4)}
    assert broken(ledger.withColumn("n", F.when(F.col("run") == "b", -F.col("n")).otherwise(F.col("n")))) == {("b", -k) for k in range(5)}


# RFC 4231, test cases 1, 2, 3, 6 and 7
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


def test_hmac_vectors(spark):
    rows = [*VECTORS, *((k, b"body", hmac.new(k, b"body", hashlib.sha256).hexdigest()) for k in (b"", b"k" * 63, b"k" * 64, b"k" * 65))]
    got = spark.createDataFrame([r[:2] for r in rows], "k binary, b binary").select(C.hmac_sha256(F.col("k"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_signatures(spark):
    good = hmac.new(b"key", "bödy".encode(), hashlib.sha256).hexdigest()
    rows = [("key", "bödy", good, True), ("key", "bödy", f"sha256= {good} ", True), ("key", "body", good, False), ("other", "bödy", good, False), ("", "bödy", good, False), ("key", "bödy", "", False), ("key", "bödy", None, False), ("key", "bödy", good.upper(), False), (None, "bödy", good, False)]
    frame = spark.createDataFrame(rows, "s string, b string, h string, ok boolean")
    assert all(r[0] == r[1] for r in frame.select(C.signature_ok(F.col("s"), F.col("b"), F.col("h")), "ok").collect())


def test_payloads(spark):
    rows = [('{"event": " page_updated ", "page": {"id": 7}}', "page_updated", "7"), ('{"event": "", "eventType": "x", "content": {"id": "08"}}', "x", "08"), ('{"page": {"id": "1 OR 1"}}', "", None), ("no json", "", None), (None, "", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "p string").select(C.event_name(F.col("p")), C.event_page(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_all_events_against_the_standard_library(spark, sf_dir):
    accepted = {r.event_id: r.accepted for r in QUERIES["signed_events"](spark, sf_dir).collect()}
    for r in logical(spark, sf_dir, "webhook_events").select("event_id", "event").collect():
        n = r.event_id
        key = b"another secret" if n % 7 == 3 else b"a secret"
        signed = hmac.compare_digest(hmac.new(key, b"x", hashlib.sha256).digest(), hmac.new(b"a secret", b"x", hashlib.sha256).digest())
        assert accepted[n] == (signed and n % 13 != 6 and n % 11 != 4 and r.event in ("page_updated", "page_created", "page_restored"))


def test_fingerprints_against_python(spark, sf_dir):
    rows = logical(spark, sf_dir, "decisions").select("run_id", "id", "jira_key", "action", "prd_section", "confidence", "reviewed").orderBy("id").collect()
    runs = {}
    for r in rows:
        runs.setdefault(r.run_id, []).append({k: r[k] for k in ("id", "jira_key", "action", "prd_section", "confidence", "reviewed")})
    want = {k: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for k, v in runs.items()}
    assert {r.run_id: r.fingerprint for r in QUERIES["run_fingerprints"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("size", [1, 7, 600])
def test_pages_resume_behind_their_token(spark, size):
    from vellum.operators.review import keyset_pages

    held = [(k,) for k in range(0, 60, 2)]
    read = lambda: spark.createDataFrame(held, "id long").repartition(3)
    seen, token = [], None
    for no, (page, token) in enumerate(keyset_pages(read, size)):
        seen += [r.id for r in page]
        held.append((1,))  # before the cursor or behind it, as it stands
        if no == 1:
            held.append((1001,))
            break
    for page, token in keyset_pages(read, size, token):
        seen += [r.id for r in page]
    assert seen == sorted(set(seen)) and set(range(0, 60, 2)) <= set(seen) and token == seen[-1]


def test_the_cursor_reaches_the_scan(spark, tmp_path, capsys):
    from vellum.operators.review import keyset_page

    spark.range(1000).write.parquet(str(tmp_path / "d"))
    page = keyset_page(spark.read.parquet(str(tmp_path / "d")), 400, 25)
    assert [r.id for r in page.collect()] == list(range(401, 426))
    page.explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(id,400)" in plan and "TakeOrderedAndProject" in plan and "Window" not in plan
