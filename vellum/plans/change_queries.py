"""Queries on changing documents: renamed sections, decisions carried across, write-back and its rollback."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.operators import renames, sync, writeback
from vellum.plans.queries import _HEADS, query


def _next_revision(c):
    """Headings at every twelfth chunk from the fourth on get a new name and a changed body, those from the tenth on a new name only."""
    k = F.col("chunk_index")
    named = (
        F.when(k % 12 == 3, F.concat(F.lit("2.1) "), F.upper("section_heading"), F.lit(" details:")))
        .when(k % 12 == 9, F.concat(F.reverse("section_heading"), F.lit(" (moved)"))).otherwise(F.col("section_heading"))
    )
    return c.withColumns({"section_heading": named, "chunk_text": F.when(k % 12 == 4, F.concat("chunk_text", F.lit(" edited"))).otherwise(F.col("chunk_text"))})


def _both(c):
    return sync.heading_hashes(sync.inherited(c)), sync.heading_hashes(sync.inherited(_next_revision(c)))


_NEXT = _HEADS.replace(
    "prd_chunks",
    """(SELECT source_id, chunk_index, CASE WHEN chunk_index % 12 = 4 THEN chunk_text || ' edited' ELSE chunk_text END AS chunk_text, CASE chunk_index % 12 WHEN 3 THEN '2.1) ' || upper(section_heading) || ' details:'
      WHEN 9 THEN reverse(section_heading) || ' (moved)' ELSE section_heading END AS section_heading FROM prd_chunks)""",
)


@query("rename_map", "prd_chunks")  # blocks of matching characters are beyond SQL: a test holds it to brute force
def rename_map(c):
    return renames.rename_map(*_both(c)).withColumn("score", F.round("score", 6))


@query("pairing_limits", "prd_chunks", sql=f"""WITH a AS ({_HEADS}), b AS ({_NEXT}), g AS (SELECT * FROM a ANTI JOIN b USING (source_id, heading)), c AS (SELECT * FROM b ANTI JOIN a USING (source_id, heading)),
    gn AS (SELECT *, row_number() OVER (PARTITION BY source_id, hash ORDER BY heading) AS no FROM g), cn AS (SELECT *, row_number() OVER (PARTITION BY source_id, hash ORDER BY heading) AS no FROM c),
    r AS (SELECT source_id, count(*) AS n_removed FROM gn ANTI JOIN cn USING (source_id, hash, no) GROUP BY source_id), n AS (SELECT source_id, count(*) AS n_added FROM cn ANTI JOIN gn USING (source_id, hash, no) GROUP BY source_id)
    SELECT source_id, n_removed, n_added, n_removed * n_added <= 100 AS titles_compared FROM r JOIN n USING (source_id)""")
def pairing_limits(c):
    return renames.pairing_limits(*_both(c), 100)


@query("section_changes", "prd_chunks")  # rests on rename_map
def section_changes(c):
    old, new = _both(c)
    return renames.section_changes(old, new, renames.rename_map(old, new))


@query(
    "carried_decisions", "decisions",
    sql="""WITH o AS (SELECT * FROM decisions WHERE run_no % 2 = 0), e AS (SELECT DISTINCT prd_source, jira_key, lower(prd_section) AS sec FROM decisions WHERE run_no % 2 = 1 AND action = 'update'),
    m AS (SELECT *, CASE WHEN prd_section = 'BUILDING' THEN '4. Construction:' ELSE prd_section END AS section, CASE WHEN prd_section = 'BUILDING' THEN 'construction' ELSE lower(prd_section) END AS sec FROM o WHERE prd_section <> 'MACHINERY'),
    k AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.prd_source = m.prd_source AND e.jira_key = m.jira_key AND e.sec = m.sec) QUALIFY row_number() OVER (PARTITION BY prd_source, jira_key, sec ORDER BY id) = 1)
    SELECT id, jira_key, section AS prd_section, '[Carried forward from ' || substring(run_id, 1, 8) || ']' || CASE id % 3 WHEN 0 THEN ' checked by hand' WHEN 1 THEN ' see [3] for the rest' ELSE '' END AS reason,
      CASE WHEN reviewed THEN approved END AS approved, coalesce(reviewed AND approved AND written_back, false) AS written_back FROM k""",
)
def carried_decisions(d):
    """Sections unchanged but one, one of them renamed; reasons with an earlier stamp, with brackets of their own, or null."""
    reason = F.expr("CASE id % 3 WHEN 0 THEN '[Carried forward from 12345678] checked by hand' WHEN 1 THEN 'see [3] for the rest' END")
    sections = d.select(F.col("prd_source").alias("source_id"), "prd_section").distinct()
    status = F.when(F.col("prd_section") == "MACHINERY", "changed").otherwise("unchanged")
    renamed = F.col("prd_section") == "BUILDING"
    changes = sections.select("source_id", F.when(renamed, "4. Construction:").otherwise(F.col("prd_section")).alias("heading"), status.alias("status"), F.when(renamed, F.col("prd_section")).alias("old_heading"))
    previous = d.where("run_no % 2 = 0").withColumn("reason", reason)
    kept = renames.carried_over(previous, d.where("run_no % 2 = 1 AND action = 'update'"), changes)
    return kept.select("id", "jira_key", "prd_section", "reason", "approved", "written_back")


# ---- write-back ----

_W_TESTS = "SELECT jira_key, summary, CASE WHEN key_no % 9 = 0 THEN %s(lang, 'DEPRECATED') WHEN key_no % 11 = 5 THEN %s() ELSE %s(lang, source) END AS labels FROM test_cases"
_W_DECISIONS = """SELECT d.id, d.run_id, p.jira_key, p.action, p.reason, d.reviewed, d.approved, d.written_back, CASE WHEN p.action = 'update' AND d.id % 3 = 0 THEN ' Better title ' || CAST(d.id AS STRING) WHEN p.action = 'create' THEN p.new_summary END AS summary,
    p.steps_json, p.suggested_changes, p.outline AS suggested_steps, CASE WHEN d.id % 8 = 3 THEN 'OLD-' || CAST(d.id AS STRING) END AS created_jira_key FROM decisions d JOIN proposals p ON d.id = p.id"""


def _writeback(t, d, p):
    spark = t.sparkSession
    for name, frame in (("test_cases", t), ("decisions", d), ("proposals", p)):
        frame.createOrReplaceTempView(f"vellum_wb_{name}")
    named = lambda sql: spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 vellum_wb_\2", sql))
    steps = F.array(F.struct(F.lit("look").alias("action"), F.lit("seen").alias("expected")))
    tests = named(_W_TESTS.replace("%s", "array")).withColumns({"labels": F.col("labels").cast("array<string>"), "steps": steps})
    planned = writeback.plan(named(_W_DECISIONS), tests)
    keys = writeback.new_tests(planned).where("position % 13 <> 2").select("run_id", "batch", "position", F.concat(F.lit("NEW-"), F.col("id").cast("string")).alias("key"))
    return tests, writeback.outcomes(planned, keys)


_STEPS_OK = """(json_valid(steps_json) AND len(from_json(steps_json, '[{"action":"VARCHAR"}]')) > 0 AND len(list_filter(from_json(steps_json, '[{"action":"VARCHAR"}]'), lambda x: trim(coalesce(x.action, '')) = '')) = 0)"""
_W = f"""w AS (SELECT * FROM ({_W_DECISIONS}) WHERE reviewed AND approved AND NOT written_back), wt AS ({_W_TESTS.replace('%s', 'list_value')}),
    e AS (SELECT w.*, wt.jira_key IS NOT NULL AS known, wt.labels, coalesce({_STEPS_OK}, false) AS ok, CASE WHEN action NOT IN ('keep', 'update', 'deprecate', 'create', 'question') THEN 'unknown_action' WHEN action IN ('update', 'deprecate') AND w.jira_key IS NULL THEN 'key_missing'
      WHEN action = 'update' AND steps_json IS NOT NULL AND steps_json <> '[]' AND NOT coalesce({_STEPS_OK}, false) THEN 'steps_invalid'
      WHEN action = 'update' AND w.summary IS NULL AND NOT coalesce({_STEPS_OK}, false) AND trim(coalesce(suggested_changes, '')) = '' THEN 'payload_missing' END AS error0 FROM w LEFT JOIN wt USING (jira_key)),
    o AS (SELECT *, CASE WHEN error0 IS NOT NULL OR action = 'keep' OR (action = 'question' AND jira_key IS NULL) THEN 'none' WHEN action = 'question' THEN 'comment' WHEN action = 'create' AND created_jira_key IS NOT NULL THEN 'adopt' ELSE action END AS op FROM e),
    b AS (SELECT *, CASE WHEN op = 'create' THEN (row_number() OVER (PARTITION BY run_id, op ORDER BY id) - 1) END AS nth FROM o),
    r AS (SELECT *, CAST(nth // 50 AS INTEGER) AS batch, CAST(nth % 50 AS INTEGER) AS position, coalesce(error0, CASE WHEN op = 'create' AND (nth % 50) % 13 = 2 THEN 'no_key_returned' END) AS error FROM b)"""


@query("writeback_outcomes", "test_cases", "decisions", "proposals", sql=f"""WITH {_W} SELECT id, op, error, CASE WHEN op = 'deprecate' AND NOT known THEN 'no_snapshot' END AS note, batch, position,
    CASE WHEN op = 'create' AND error IS NULL THEN 'NEW-' || id::VARCHAR END AS created_key FROM r""")
def writeback_outcomes(t, d, p):
    return _writeback(t, d, p)[1].select("id", "op", "error", "note", "batch", "position", "created_key")


@query("writeback_library", "test_cases", "decisions", "proposals", sql=f"""WITH {_W}, c AS (SELECT jira_key, arg_max(trim(r.summary), id) FILTER (WHERE op = 'update' AND r.summary IS NOT NULL) AS s, bool_or(op = 'deprecate') AS gone, bool_or(op = 'update' AND ok) AS stepped
      FROM r WHERE error IS NULL AND op IN ('update', 'deprecate') GROUP BY jira_key)
    SELECT jira_key, coalesce(s, summary) AS summary, array_to_string(CASE WHEN gone AND NOT list_contains(labels, 'DEPRECATED') THEN list_append(labels, 'DEPRECATED') ELSE labels END, ',') AS labels, coalesce(stepped, false) AS stepped FROM wt LEFT JOIN c USING (jira_key)
    UNION ALL SELECT 'NEW-' || id::VARCHAR, coalesce(summary, 'New test case'), '', ok OR coalesce(regexp_matches(suggested_steps, '(?m)^\\s*(?:\\d+\\s*[.)\\-:]|[-*•]|[Ss]tep\\s*\\d+\\s*[:.)\\-])\\s*\\S'), false) FROM r WHERE op = 'create' AND error IS NULL""")
def writeback_library(t, d, p):
    """The library after the write-back; ``stepped`` where its steps are new."""
    tests, results = _writeback(t, d, p)
    stepped = F.coalesce(F.get("steps", 0)["action"] != "look", F.lit(False))
    return writeback.applied(results, tests).select("jira_key", "summary", F.array_join("labels", ",").alias("labels"), stepped.alias("stepped"))


@query("writeback_counts", "test_cases", "decisions", "proposals", sql=f"WITH {_W} SELECT action, count(*) FILTER (WHERE error IS NULL) AS written, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE error IS NULL AND op = 'deprecate' AND NOT known) AS noted FROM r GROUP BY action")
def writeback_counts(t, d, p):
    return writeback.counts(_writeback(t, d, p)[1])


@query("rollback_labels", "test_cases", "decisions", "proposals", sql=f"""WITH {_W} SELECT id, CASE WHEN action <> 'deprecate' THEN 'not_a_deprecation' WHEN error IS NOT NULL THEN 'not_written_back' WHEN NOT known THEN 'no_snapshot' END AS problem,
    CASE WHEN action = 'deprecate' AND error IS NULL AND known THEN array_to_string(labels, ',') END AS restored FROM r""")
def rollback_labels(t, d, p):
    """After write-back and rollback of all that can be: what stood in the way, or the labels that the library has again."""
    tests, results = _writeback(t, d, p)
    wanted = writeback.rollback_plan(results.withColumn("written_back", F.col("done")))
    after = writeback.rolled_back(writeback.applied(results, tests), wanted).select("jira_key", F.array_join("labels", ",").alias("labels"))
    return wanted.join(after, "jira_key", "left").select("id", "problem", F.when(F.col("problem").isNull(), F.col("labels")).alias("restored"))
