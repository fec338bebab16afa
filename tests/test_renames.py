from collections import defaultdict
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions.text import normalized_heading
from vellum.operators import renames, sync
from vellum.plans.change_queries import _both, section_changes
from vellum.plans.logical import logical
from vellum.plans.queries import QUERIES

HEADS = "source_id string, heading string, hash string"


def normal(spark, headings):
    rows = spark.createDataFrame([(h,) for h in headings], "h string").select("h", normalized_heading(F.col("h")).alias("n")).collect()
    return {r.h: r.n for r in rows}


def brute(spark, old, new, floor=0.70, most=10_000):
    """Both rules, source by source, in plain Python."""
    norm = normal(spark, {h for _, h, _ in old} | {h for _, h, _ in new})
    out = set()
    for source in {s for s, *_ in old} | {s for s, *_ in new}:
        a, b = ({h: x for s, h, x in side if s == source} for side in (old, new))
        gone, come = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        by_hash = defaultdict(list)
        for h in come:
            by_hash[b[h]].append(h)
        for h in list(gone):
            if by_hash[a[h]]:
                other = by_hash[a[h]].pop(0)
                out.add((source, h, other, "content", 1.0))
                gone.remove(h)
                come.remove(other)
        if len(gone) * len(come) > most:
            continue
        pairs = sorted((-SequenceMatcher(None, norm[x], norm[y]).ratio(), x, y) for x in gone for y in come)
        used = set()
        for score, x, y in pairs:
            if -score >= floor and ("o", x) not in used and ("n", y) not in used:
                used |= {("o", x), ("n", y)}
                out.add((source, x, y, "title", round(-score, 6)))
    return out


def run(spark, old, new, **args):
    got = renames.rename_map(spark.createDataFrame(old, HEADS), spark.createDataFrame(new, HEADS), **args).collect()
    assert len({(r.source_id, r.old_heading) for r in got}) == len({(r.source_id, r.new_heading) for r in got}) == len(got)
    return {(r.source_id, r.old_heading, r.new_heading, r.rule, round(r.score, 6)) for r in got}


def test_known_pairs(spark):
    old = [("a", "User Login", "1"), ("a", "Checkout Page", "2"), ("a", "Refund Limits", "3"), ("a", "3.2 Payment Capture", "4"), ("a", "Kept", "5"), ("b", "API Rate Limits", "6"), ("c", "Only old", "7"), ("d", "Same", "8"), ("d", "Twin", "8")]
    new = [("a", "Authentication Flow", "1"), ("a", "Checkout Page Updated", "x2"), ("a", "Shipping Options", "x3"), ("a", "Payment Capture", "x4"), ("a", "Kept", "x5"), ("b", "Rate Limiting", "x6"), ("e", "Only new", "7"), ("d", "Other", "8"), ("d", "Another", "8")]
    got = run(spark, old, new)
    assert got == brute(spark, old, new)
    assert {(o, n, r) for _, o, n, r, _ in got} == {
        ("User Login", "Authentication Flow", "content"), ("Checkout Page", "Checkout Page Updated", "title"), ("3.2 Payment Capture", "Payment Capture", "title"),
        ("API Rate Limits", "Rate Limiting", "title"), ("Same", "Another", "content"), ("Twin", "Other", "content"),
    }


@settings(max_examples=12, deadline=None)
@given(st.data())
def test_ties_and_chains_against_brute_force(spark, data):
    side = st.dictionaries(st.tuples(st.sampled_from("xy"), st.text("ab 1.", min_size=1, max_size=6)), st.sampled_from("pqrstuv"), max_size=14)
    old, new = ([(s, h, x) for (s, h), x in data.draw(side).items()] for _ in range(2))
    assert run(spark, old, new) == brute(spark, old, new)


def test_large_sources_are_flagged_not_dropped(spark):
    old, new = [("big", f"Part {k}", f"o{k}") for k in range(40)], [("big", f"Part {k}", f"n{k}") for k in range(40, 80)]
    old, new = [*old, ("big", "Moved", "same"), ("small", "Plan", "1")], [*new, ("big", "Elsewhere", "same"), ("small", "The plan", "2")]
    assert run(spark, old, new, most_pairs=1000) == brute(spark, old, new, most=1000)
    limits = renames.pairing_limits(spark.createDataFrame(old, HEADS), spark.createDataFrame(new, HEADS), 1000).collect()
    assert {tuple(r) for r in limits} == {("big", 40, 40, False), ("small", 1, 1, True)}


def test_empty_sides(spark):
    assert run(spark, [], []) == run(spark, [("a", "x", "1")], []) == run(spark, [], [("a", "x", "1")]) == set()


def test_whole_table_against_brute_force(spark, sf_dir):
    old, new = ([tuple(r) for r in d.select("source_id", "heading", "hash").collect()] for d in _both(logical(spark, sf_dir, "prd_chunks")))
    got = {tuple(r[c] for c in ("source_id", "old_heading", "new_heading", "rule", "score")) for r in QUERIES["rename_map"](spark, sf_dir).collect()}
    assert got == brute(spark, old, new) and {r[3] for r in got} == {"content", "title"}
    hashes = {(s, h): x for s, h, x in new}, {(s, h): x for s, h, x in old}
    pairs = {(s, n): o for s, o, n, *_ in got}
    for r in section_changes(logical(spark, sf_dir, "prd_chunks")).collect():
        assert r.old_heading == pairs.get((r.source_id, r.heading))
        now, was = hashes[0].get((r.source_id, r.heading)), hashes[1].get((r.source_id, r.old_heading or r.heading))
        assert r.status == ("new" if was is None else "removed" if now is None else "unchanged" if now == was else "changed")


def test_carried_over_a_rename(spark):
    """A renamed section takes its decisions along; a second stamp replaces the first."""
    old, new = [("s", "Login", "1"), ("s", "Cart", "2"), ("s", "Gone", "3")], [("s", "Sign in", "1"), ("s", "Cart", "x")]
    changes = renames.section_changes(spark.createDataFrame(old, HEADS), spark.createDataFrame(new, HEADS), renames.rename_map(spark.createDataFrame(old, HEADS), spark.createDataFrame(new, HEADS)))
    rows = [(1, "run-number-1", "s", "1. LOGIN:", "T-1", "as it was", True, True, True), (2, "run-number-1", "s", "Cart", "T-2", "x", True, True, True), (3, "run-number-1", "s", "login", "T-1", "again", False, None, False), (4, "run-number-1", "s", "Login", None, "[Carried forward from abc] why] so", False, True, True)]
    d = spark.createDataFrame(rows, "id long, run_id string, prd_source string, prd_section string, jira_key string, reason string, reviewed boolean, approved boolean, written_back boolean")
    got = {r.id: r for r in renames.carried_over(d, d.limit(0), changes).collect()}
    assert set(got) == {1, 4} and got[1].prd_section == "Sign in" and got[1].reason == "[Carried forward from run-numb] as it was" and got[1].written_back
    assert got[4].reason == "[Carried forward from run-numb] why] so" and got[4].approved is None and not got[4].written_back
    assert [r.id for r in renames.carried_over(d, d.where("id = 1").withColumn("prd_section", F.lit("sign in")), changes).collect()] == [4]
    assert sync.heading_diff(spark.createDataFrame(old, HEADS), spark.createDataFrame(new, HEADS)).count() == 4
