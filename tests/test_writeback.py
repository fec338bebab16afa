import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import writeback as W

DECISIONS = "id long, run_id string, jira_key string, action string, reason string, reviewed boolean, approved boolean, written_back boolean, summary string, steps_json string, suggested_changes string, suggested_steps string, created_jira_key string"
TESTS = "jira_key string, summary string, labels array<string>, steps array<struct<action:string,expected:string>>"


def decision(no, action, key=None, run="r", ready=(True, True, False), **content):
    return (no, run, key, action, "why", *ready, *(content.get(c) for c in W.CONTENT))


def frames(spark, decisions, tests):
    return spark.createDataFrame(decisions, DECISIONS), spark.createDataFrame(tests, TESTS)


def test_every_branch(spark):
    steps = json.dumps([{"action": "go", "expectedResult": "there"}])
    decisions = [
        decision(1, "keep", "T-1"), decision(2, "question", "T-1"), decision(3, "question"), decision(4, "update", "T-1", summary=" New "), decision(5, "update", "T-2", steps_json=steps),
        decision(6, "update", "T-2", steps_json='[{"data": 1}]', summary="x"), decision(7, "update", "T-2"), decision(8, "update", summary="x"), decision(9, "update", "T-2", suggested_changes="prose"),
        decision(10, "deprecate", "T-3"), decision(11, "deprecate", "T-4"), decision(12, "deprecate", "T-9"), decision(13, "deprecate"), decision(14, "create", summary="Made", suggested_steps="1. a -> b\n2. c"),
        decision(15, "create", suggested_steps="just prose"), decision(16, "create", created_jira_key="T-77"), decision(17, "create", summary="Lost"), decision(18, "remove", "T-1"), decision(19, "keep", ready=(True, False, False)), decision(20, "deprecate", "T-1", ready=(True, True, True)),
    ]
    tests = [("T-1", "one", ["a"], None), ("T-2", "two", None, [("x", "y")]), ("T-3", "three", ["b"], None), ("T-4", "four", ["DEPRECATED", "c"], None)]
    d, t = frames(spark, decisions, tests)
    planned = W.plan(d, t)
    asked = {r.id: r for r in W.new_tests(planned).collect()}
    assert [(s.action, s.expected) for s in asked[14].steps] == [("a", "b"), ("c", "")] and asked[15].steps is None and (asked[15].summary, asked[15].description) == ("New test case", "just prose")
    assert {(r.batch, r.position) for r in asked.values()} == {(0, 0), (0, 1), (0, 2)}
    keys = spark.createDataFrame([("r", 0, 0, "N-1"), ("r", 0, 1, "N-2")], "run_id string, batch int, position int, key string")
    results = W.outcomes(planned, keys)
    got = {r.id: (r.op, r.error, r.note) for r in results.collect()}
    assert got == {
        1: ("none", None, None), 2: ("comment", None, None), 3: ("none", None, None), 4: ("update", None, None), 5: ("update", None, None), 6: ("none", "steps_invalid", None), 7: ("none", "payload_missing", None),
        8: ("none", "key_missing", None), 9: ("update", None, None), 10: ("deprecate", None, None), 11: ("deprecate", None, None), 12: ("deprecate", None, "no_snapshot"), 13: ("none", "key_missing", None),
        14: ("create", None, None), 15: ("create", None, None), 16: ("adopt", None, None), 17: ("create", "no_key_returned", None), 18: ("none", "unknown_action", None),
    }
    after = {r.jira_key: (r.summary, r.labels, r.steps and [tuple(s) for s in r.steps]) for r in W.applied(results, t).collect()}
    assert after == {
        "T-1": ("New", ["a"], None), "T-2": ("two", None, [("go", "there")]), "T-3": ("three", ["b", "DEPRECATED"], None), "T-4": ("four", ["DEPRECATED", "c"], None),
        "N-1": ("Made", [], [("a", "b"), ("c", "")]), "N-2": ("New test case", [], None),
    }
    assert {r.action: (r.written, r.failed, r.noted) for r in W.counts(results).collect()} == {"keep": (1, 0, 0), "question": (2, 0, 0), "update": (3, 3, 0), "deprecate": (3, 1, 1), "create": (3, 1, 0), "remove": (0, 1, 0)}
    assert {r.id: r.error for r in W.plan(d, t, project=None).where("action = 'create'").collect()} == {14: "project_missing", 15: "project_missing", 16: None, 17: "project_missing"}
    totals, sample = W.dry_run(planned, 3)
    assert sum(r.n for r in totals.collect()) == 18 and [r.id for r in sample.collect()] == [1, 2, 3]
    back = W.rollback_plan(results.withColumn("written_back", F.col("done")))
    assert {r.id: r.problem for r in back.where("id > 9 AND id < 14").collect()} == {10: None, 11: None, 12: "no_snapshot", 13: "not_written_back"}
    kinds = {(r.decision_id, r.change_type) for r in W.ancestry(results, back).collect()}
    assert kinds == {(4, "updated"), (5, "updated"), (9, "updated"), (10, "deprecated"), (11, "deprecated"), (12, "deprecated"), (14, "created"), (15, "created"), (10, "rolled_back"), (11, "rolled_back")}


LABELS = st.none() | st.lists(st.sampled_from(["a", "b", "DEPRECATED", ""]), max_size=3)


@settings(max_examples=10, deadline=None)
@given(st.lists(LABELS, min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 7), st.sampled_from(["deprecate", "keep", "question"])), max_size=12))
def test_rollback_undoes_deprecations(spark, labels, asked):
    """Write-back and rollback of everything leave all labels as they were, whatever was deprecated how often."""
    tests = [(f"T-{k}", f"test {k}", x, None) for k, x in enumerate(labels)]
    d, t = frames(spark, [decision(n, action, f"T-{k}") for n, (k, action) in enumerate(asked)], tests)
    results = W.outcomes(W.plan(d, t), spark.createDataFrame([], "run_id string, batch int, position int, key string"))
    after = W.applied(results, t)
    hit = {f"T-{k}" for k, action in asked if action == "deprecate"}
    assert all(("DEPRECATED" in (r.labels or [])) for r in after.collect() if r.jira_key in hit)
    back = W.rolled_back(after, W.rollback_plan(results.withColumn("written_back", F.col("done"))))
    was = {k: x for k, _, x, _ in tests}
    assert {r.jira_key: r.labels if was[r.jira_key] is not None or r.labels else r.labels for r in back.collect()} == {k: x for k, x in was.items() if x is not None or k not in hit} | {k: ["DEPRECATED"] for k, x in was.items() if x is None and k in hit}


def test_creations_go_in_batches_of_fifty(spark):
    d, t = frames(spark, [decision(n, "create", run=f"r{n % 2}", summary=str(n)) for n in range(240)], [])
    rows = W.plan(d, t).collect()
    assert all((r.batch, r.position) == divmod(r.id // 2, 50) for r in rows)
