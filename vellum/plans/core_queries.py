"""More queries of the review engine: guards, ingest, chunk search and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import answers, coverage, documents, guards, ingest, review, search, sync
from vellum.plans.queries import _COS, _INHERITED, _KNN, EVERY, IR_METRICS as ORACLE_METRICS, as_of, asked, ir_metrics, query

_PHRASE = "concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(%s), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' '), ' ')"
_CHUNKS = f"""q AS (SELECT jira_key AS query_id, key_no, embedding AS q FROM test_cases WHERE mod(key_no, {EVERY}) = 0),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM (SELECT query_id, key_no, source_id, chunk_no, {_COS} AS score FROM q, prd_vectors %s)) WHERE rank <= 8)"""


def _hits(t, c, condition=None):
    return search.knn(c, asked(t), 8, "chunk_no", condition)


@query("knn_chunks", "test_cases", "prd_vectors", sql=f"WITH {_CHUNKS % ('WHERE contains(' + _PHRASE.replace('%s', 'doc_title') + ", ' prd ')")} SELECT query_id, chunk_no, score, rank FROM hits")
def knn_chunks(t, c):
    return _hits(t, c, guards.has_phrase(F.col("doc_title"), "PRD"))


@query("title_contains", "prd_vectors", sql=f"SELECT chunk_no FROM prd_vectors WHERE contains({_PHRASE.replace('%s', 'doc_title')}, ' implementation plan ')")
def title_contains(c):
    return c.where(guards.has_phrase(F.col("doc_title"), "Implementation  PLAN")).select("chunk_no")


@query(
    "covered_elsewhere", "test_cases", "prd_vectors",
    sql=f"""WITH {_CHUNKS % ''} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM (
      SELECT query_id, source_id, max(score) AS score, arg_min(chunk_no, {{'a': -score, 'b': chunk_no}}) AS chunk_no FROM hits WHERE source_id <> 'doc:' || (key_no % 40)::VARCHAR AND score >= 0.6 GROUP BY query_id, source_id)) WHERE rank <= 3""",
)
def covered_elsewhere(t, c):
    own = F.concat(F.lit("doc:"), (F.col("key_no") % 40).cast("string"))
    hits = _hits(t, c).join(c.select("chunk_no", "source_id"), "chunk_no").join(t.select(F.col("jira_key").alias("query_id"), own.alias("own_source")), "query_id")
    return search.covered_elsewhere(hits, 0.6)


@query("kb_matches", "test_cases", "prd_vectors", sql=f"""WITH {_CHUNKS % ''} SELECT query_id, chunk_no, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS r FROM hits
    WHERE rank <= 7 AND source_id <> 'doc:' || (key_no % 40)::VARCHAR AND score >= 0.6) WHERE r <= 5""")
def kb_matches(t, c):
    """Over-fetched hits, other sources only, then the best five."""
    from pyspark.sql import Window

    own = F.concat(F.lit("doc:"), (F.col("key_no") % 40).cast("string"))
    hits = _hits(t, c).where("rank <= 7").join(c.select("chunk_no", "source_id"), "chunk_no").join(t.select(F.col("jira_key").alias("query_id"), own.alias("own_source")), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_no")
    return hits.where("source_id <> own_source AND score >= 0.6").withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", "chunk_no", "score")


@query("score_bands", "test_cases", sql=f"WITH {_KNN % ('', 10)} SELECT query_id, jira_key, CASE WHEN score >= 0.7 THEN 'high' ELSE 'medium' END AS band FROM knn WHERE score >= 0.65")
def score_bands(t):
    return search.knn(t, asked(t), 10).select("query_id", "jira_key", guards.banded(F.col("score"), 0.7, 0.65).alias("band")).where("band IS NOT NULL")


@query(
    "best_score_merge", "test_cases",
    sql=f"""WITH {_KNN % ('', 10)}, h AS (SELECT 'M' || (substring(query_id, 6)::BIGINT // {EVERY} % 5)::VARCHAR AS g, substring(query_id, 6)::BIGINT AS query_no, jira_key, score FROM knn),
    b AS (SELECT g, jira_key, max(score) AS score FROM h GROUP BY ALL), f AS (SELECT g, jira_key, b.score, min(query_no) FILTER (WHERE h.score = b.score) AS first_no FROM h JOIN b USING (g, jira_key) GROUP BY ALL)
    SELECT g AS "group", jira_key, f.score, string_agg(DISTINCT query_no::VARCHAR, ',' ORDER BY query_no::VARCHAR) AS matched FROM f JOIN h USING (g, jira_key) WHERE query_no >= first_no GROUP BY g, jira_key, f.score""",
)
def best_score_merge(t):
    no = F.substring("query_id", 6, 20).cast("long")
    hits = search.knn(t, asked(t), 10).select(F.concat(F.lit("M"), (F.floor(no / EVERY) % 5).cast("string")).alias("group"), no.alias("query_no"), "jira_key", "score")
    merged = search.merged_best(hits)
    return merged.select("group", "jira_key", "score", F.array_join(F.array_sort(F.split("matched_queries", ",")), ",").alias("matched"))


@query("module_contamination", "test_cases", sql=f"""WITH {_KNN % ('', 10)} SELECT k.query_id, count(*) AS strangers FROM knn k JOIN test_cases a ON a.jira_key = k.query_id JOIN test_cases b ON b.jira_key = k.jira_key
    WHERE lower(a.module) <> lower(b.module) GROUP BY k.query_id""")
def module_contamination(t):
    """Results of another module than the query's."""
    near = search.knn(t, asked(t), 10).join(t.select(F.col("jira_key").alias("query_id"), F.lower("module").alias("own")), "query_id").join(t.select("jira_key", F.lower("module").alias("other")), "jira_key")
    return near.where("own <> other").groupBy("query_id").agg(F.count("*").alias("strangers"))


@query("module_list", "test_cases", sql="""SELECT jira_key, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i)), ',') END AS modules
    FROM (SELECT jira_key, list_filter(list_transform([' ' || module, lower(module), source, '  ', upper(source)], lambda x: trim(x)), lambda x: x <> '') AS m FROM test_cases)""")
def module_list(t):
    asked_for = F.array(F.concat(F.lit(" "), "module"), F.lower("module"), "source", F.lit("  "), F.upper("source"))
    return t.select("jira_key", F.array_join(guards.normalized_modules(F.filter(asked_for, lambda x: x.isNotNull())), ",").alias("modules"))


@query("unknown_modules", "test_cases", sql="""WITH a AS (SELECT list(DISTINCT module) AS known FROM test_cases WHERE module IS NOT NULL)
    SELECT jira_key, CASE WHEN NOT list_has_any(['M' || (key_no % 14)::VARCHAR, lower(module)], known) THEN 'module_not_found' END AS problem FROM test_cases, a""")
def unknown_modules(t):
    requested = F.array(F.concat(F.lit("M"), (F.col("key_no") % 14).cast("string")), F.coalesce(F.lower("module"), F.lit("")))
    return guards.module_problems(t.select("jira_key", requested.alias("requested")), t, "jira_key")


_NORMAL = f"trim(lower(regexp_replace(regexp_replace(trim(regexp_replace(trim(coalesce(%s, '')), '{T.HEADING_PREFIX}', '')), '\\s+', ' ', 'g'), '[\\s:;.\\-–—•]+$', '')))"


@query("focus_filter", "prd_chunks", sql=f"""WITH h AS ({_INHERITED.replace("prd_chunks", "(SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN '2.1) ' || section_heading || ' -' ELSE section_heading END AS section_heading) FROM prd_chunks)")}),
    f AS (SELECT DISTINCT heading AS f FROM h WHERE doc_id % 2 = 1 AND length(heading) % 3 = 0), w AS (SELECT f FROM f UNION SELECT {_NORMAL.replace("%s", "f")} FROM f)
    SELECT source_id, chunk_index FROM h WHERE heading IN (SELECT f FROM w WHERE f <> '') OR {_NORMAL.replace("%s", "heading")} IN (SELECT f FROM w WHERE f <> '')""")
def focus_filter(c):
    """Headings of half of the documents are numbered; the focus names those of the other half, so only the normalized form meets them."""
    named = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2.1) "), "section_heading", F.lit(" -"))).otherwise(F.col("section_heading"))
    heads = sync.inherited(c.withColumn("section_heading", named))
    focus = heads.where("doc_id % 2 = 1 AND length(heading) % 3 = 0").select(F.col("heading").alias("focus_heading")).distinct()
    return guards.in_focus(heads, focus).select("source_id", "chunk_index")


@query("decision_problems", "proposals", "decisions", sql="""WITH seen AS (SELECT DISTINCT jira_key FROM decisions)
    SELECT p.id, CASE WHEN p.action NOT IN ('keep', 'update', 'deprecate', 'create', 'question') THEN 'unknown_action' WHEN length(trim(p.reason)) < 30 THEN 'too_short'
      WHEN p.action = 'deprecate' AND NOT regexp_matches(lower(p.reason), 'remov') THEN 'no_removal_named' WHEN p.action IN ('keep', 'update', 'deprecate') AND p.jira_key IS NULL THEN 'key_missing'
      WHEN p.action = 'update' AND trim(coalesce(suggested_changes, '')) = '' THEN 'changes_missing' WHEN p.action = 'create' AND p.new_summary IS NULL THEN 'summary_missing'
      WHEN p.action = 'create' AND p.jira_key IS NOT NULL THEN 'key_not_allowed' WHEN p.jira_key IS NOT NULL AND s.jira_key IS NULL THEN 'key_not_retrieved' END AS problem
    FROM proposals p LEFT JOIN seen s USING (jira_key)""")
def decision_problems(p, d):
    return guards.decision_problem(p, d).select("id", "problem")


@query("advise_once", "proposals", sql="""WITH a AS (SELECT id, action || ':' || coalesce(jira_key, '') AS identity, CASE id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'warn' WHEN 2 THEN 'warn' ELSE 'ok' END AS verdict FROM proposals)
    SELECT id, CASE WHEN verdict = 'block' THEN 'refused' WHEN verdict = 'warn' AND coalesce(sum((verdict = 'warn')::INT) OVER (PARTITION BY identity ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'advised' ELSE 'passes' END AS outcome FROM a""")
def advise_once(p):
    verdict = F.when(F.col("id") % 5 == 0, "block").when((F.col("id") % 5).isin(1, 2), "warn").otherwise("ok")
    tried = p.select("id", F.lit("duplicate").alias("guard"), F.concat("action", F.lit(":"), F.coalesce("jira_key", F.lit(""))).alias("identity"), F.col("id").alias("attempt_no"), verdict.alias("verdict"))
    return guards.advised_once(tried).select("id", "outcome")


@query("step_lists", "proposals", sql="""WITH s AS (SELECT id, CASE WHEN json_valid(steps_json) THEN from_json(steps_json, '[{"action":"VARCHAR","data":"VARCHAR","expectedResult":"VARCHAR","result":"VARCHAR"}]') END AS s FROM proposals)
    SELECT id, CASE WHEN len(s) > 0 AND len(list_filter(s, lambda x: trim(coalesce(x.action, '')) = '')) = 0 THEN
      array_to_string(list_transform(s, lambda x, i: i::VARCHAR || ':' || trim(x.action) || '/' || trim(coalesce(x.data, '')) || '/' || trim(coalesce(nullif(x.expectedResult, ''), x.result, ''))), ';') END AS steps FROM s""")
def step_lists(p):
    line = lambda s: F.concat(s["index"].cast("string"), F.lit(":"), s["action"], F.lit("/"), s["data"], F.lit("/"), s["expected"])
    return p.select("id", F.array_join(F.transform(guards.valid_steps(F.col("steps_json")), line), ";").alias("steps"))


_OUT = r"(?i)^\s*(?:\d+\s*[.)\-:]|[-*•]|step\s*\d+\s*[:.)\-])\s*(.+)$"
_EXP = r"(?i)\s*(?:->|=>|→|\|\s*expected\s*:|\bexpected\s*:)\s*"


@query("outline_steps", "proposals", sql=f"""WITH l AS (SELECT id, list_filter(list_transform(list_filter(string_split(outline, chr(10)), lambda x: regexp_matches(x, '{_OUT}')), lambda x: trim(regexp_extract(x, '{_OUT}', 1))), lambda x: x <> '') AS b FROM proposals)
    SELECT id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(b, lambda x: trim(regexp_replace(x, '(?i)^(.*?)\\s*(?:->|=>|→|\\|\\s*expected\\s*:|\\bexpected\\s*:)\\s*(.*)$', '\\1~\\2')) || CASE WHEN regexp_matches(x, '{_EXP}') THEN '' ELSE '~' END), ';') END AS steps FROM l""")
def outline_steps(p):
    return p.select("id", F.array_join(F.transform(guards.outline_steps(F.col("outline")), lambda s: F.concat(s["action"], F.lit("~"), s["expected"])), ";").alias("steps"))


@query("question_context", "proposals", sql="SELECT id, concat_ws(' | ', 'PRD: ' || prd_source, 'Section: ' || prd_section, 'Run: ' || run_id) AS context FROM proposals WHERE action = 'question' AND jira_key IS NOT NULL")
def question_context(p):
    return p.where("action = 'question' AND jira_key IS NOT NULL").select("id", guards.question_context(F.col("prd_source"), F.col("prd_section"), F.col("run_id")).alias("context"))


_LAST = "SELECT prd_source, run_id, status FROM runs WHERE run_type = 'analysis' QUALIFY row_number() OVER (PARTITION BY prd_source ORDER BY completed_at DESC NULLS LAST, run_no DESC) = 1"


@query("webhook_actions", "webhook_events", "runs", sql=f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'skipped_at_capacity' WHEN r.run_id IS NOT NULL THEN 'incremental' ELSE 'full' END AS action
    FROM webhook_events e LEFT JOIN ({_LAST}) r ON r.prd_source = 'doc:' || (page_id % 150)::VARCHAR WHERE event IN ('page_updated', 'page_created', 'page_restored')""")
def webhook_actions(e, r):
    last = review.last_analysis(r)
    changed = e.where("event IN ('page_updated', 'page_created', 'page_restored')").withColumn("prd_source", F.concat(F.lit("doc:"), (F.col("page_id") % 150).cast("string")))
    free = F.when(F.col("event_id") % 7 == 0, 0).otherwise(1)
    return changed.join(last, "prd_source", "left").select("event_id", guards.webhook_action(F.col("run_id"), True, True, free).alias("action"))


@query("repeated_runs", "runs", sql="SELECT run_id, status IN ('completed', 'completed_empty', 'truncated') AS returns_old FROM runs")
def repeated_runs(r):
    return r.select("run_id", guards.repeats_finished_run(F.col("status")).alias("returns_old"))


@query("triage_turns", "decisions", sql="SELECT id, CASE WHEN id % 40 > 10 THEN id % 40 - 10 WHEN id % 40 > 2 THEN greatest(1, floor((id % 40) * 0.7)::INT) END::INT AS warn_at FROM decisions")
def triage_turns(d):
    return d.select("id", guards.triage_turn((F.col("id") % 40).cast("int")).alias("warn_at"))


_WRITTEN = "SELECT source_id, chunk_index, 'new' AS origin FROM prd_chunks WHERE doc_id % 3 = 0 AND (doc_id % 2 = 0 OR chunk_index > 0)"


@query("replace_by_source", "prd_chunks", sql=f"""WITH w AS ({_WRITTEN}), i AS (SELECT source_id, count(*) AS n FROM prd_chunks WHERE doc_id % 3 < 2 GROUP BY ALL), whole AS (SELECT i.source_id FROM i JOIN (SELECT source_id, count(*) AS m FROM w GROUP BY ALL) USING (source_id) WHERE m >= n)
    SELECT source_id, chunk_index, 'old' AS origin FROM prd_chunks WHERE source_id NOT IN (SELECT source_id FROM whole) UNION ALL SELECT * FROM w""")
def replace_by_source(c):
    """Some sources written whole, some without their first chunk, some not at all."""
    written = c.where("doc_id % 3 = 0 AND (doc_id % 2 = 0 OR chunk_index > 0)").select("source_id", "chunk_index", F.lit("new").alias("origin"))
    intended = c.where("doc_id % 3 < 2").groupBy("source_id").agg(F.count("*").alias("n_intended"))
    return ingest.replaced_by_source(c.select("source_id", "chunk_index", F.lit("old").alias("origin")), written, intended)


@query("delete_sources", "prd_chunks", sql="SELECT source_id, count(*) AS n_deleted FROM prd_chunks WHERE doc_id % 9 = 0 GROUP BY source_id UNION ALL SELECT 'doc:none', 0")
def delete_sources(c):
    gone = c.where("doc_id % 9 = 0").select("source_id").union(c.sparkSession.createDataFrame([("doc:none",)], "source_id string"))
    return ingest.deleted(c, gone)[1]


@query("source_ids", "prd_chunks", sql="SELECT DISTINCT source_id FROM prd_chunks")
def source_ids(c):
    return c.select("source_id").distinct()


@query("insert_decisions", "decisions", sql="""SELECT id, substring(run_id, 1, 64) AS run_id, 'because ' || action AS reason, substring(prd_section, 1, 500) AS prd_section, CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence END AS confidence,
    coalesce(reviewed, false) AS reviewed, CASE WHEN reviewed THEN TIMESTAMP '2001-08-02' END AS reviewed_at FROM decisions""")
def insert_decisions(d):
    raw = d.withColumns({"reason": F.concat(F.lit("because "), "action"), "confidence": F.concat(F.lit(" "), F.upper("confidence"))})
    return ingest.new_decisions(raw, as_of())


@query("merge_content", "decisions", sql="SELECT id, 'a=' || action || CASE WHEN reviewed THEN ',b=new,c=' || run_id ELSE ',b=old' END AS merged FROM decisions")
def merge_content(d):
    old = F.create_map(F.lit("a"), "action", F.lit("b"), F.lit("old"))
    patch = F.when(F.col("reviewed"), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("run_id")))
    pairs = F.array_sort(F.map_entries(ingest.merged_maps(old, patch)))
    return d.select("id", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


@query("ancestry", "proposals", sql="SELECT id, nullif(substring(CASE WHEN id % 3 = 0 THEN '' ELSE repeat(reason, 20) END, 1, 500), '') AS reason FROM proposals")
def ancestry(p):
    return p.select("id", ingest.ancestry_reason(F.when(F.col("id") % 3 == 0, "").otherwise(F.repeat("reason", 20))).alias("reason"))


@query("content_diff", "listing_old", "listing_new", sql="SELECT n.jira_key, sha256(n.summary) IS DISTINCT FROM sha256(o.summary) AS changed FROM listing_new n LEFT JOIN listing_old o USING (jira_key)")
def content_diff(o, n):
    hashed = lambda t: t.select("jira_key", F.sha2("summary", 256).alias("hash"))
    return ingest.content_changed(hashed(o), hashed(n))


@query("enriched_tests", "listing_new", "listing_old", sql="""SELECT n.jira_key, CASE WHEN o.updated % 2 = 0 THEN o.label_a ELSE n.label_a || ',' || n.label_b END AS labels, coalesce(o.summary, '') AS description, coalesce(CASE WHEN o.updated % 3 > 0 THEN o.label_b END, '') AS steps_text
    FROM listing_new n LEFT JOIN listing_old o USING (jira_key)""")
def enriched_tests(n, o):
    detail = o.select("jira_key", F.when(F.col("updated") % 2 == 0, F.array("label_a")).otherwise(F.array().cast("array<string>")).alias("labels"), F.col("summary").alias("description"), F.when(F.col("updated") % 3 > 0, F.col("label_b")).alias("steps_text"))
    out = ingest.enriched(n.select("jira_key", F.array("label_a", "label_b").alias("labels")), detail)
    return out.withColumn("labels", F.array_join("labels", ","))


_KIND = "CASE WHEN chunk_text LIKE '%|%' THEN 'table' WHEN length(chunk_text) % 5 = 0 THEN 'mixed' ELSE 'prose' END"


@query("chunk_stats", "prd_chunks", sql=f"""SELECT source_id, count(*) AS n, min(size) AS least, list_sort(list(size))[count(*) // 2 + 1] AS median, max(size) AS most, sum(size)::BIGINT AS total, count(*) FILTER (WHERE kind = 'table') AS n_table, 0::BIGINT AS n_code,
    count(*) FILTER (WHERE kind = 'mixed') AS n_mixed, count(*) FILTER (WHERE kind = 'prose') AS n_prose FROM (SELECT source_id, length(chunk_text) AS size, {_KIND} AS kind FROM prd_chunks) GROUP BY source_id""")
def chunk_stats(c):
    return ingest.size_stats(c.select("source_id", F.length("chunk_text").alias("size"), F.expr(_KIND).alias("kind")), "source_id")


@query("sync_summary", "listing_old", "listing_new", sql="""SELECT (SELECT count(*) FROM listing_new n LEFT JOIN listing_old o USING (jira_key) WHERE n.summary IS DISTINCT FROM o.summary) AS upserted, (SELECT count(*) FROM listing_new n JOIN listing_old o USING (jira_key) WHERE n.summary = o.summary) AS unchanged,
    (SELECT count(*) FROM listing_old WHERE jira_key NOT IN (SELECT jira_key FROM listing_new)) AS deleted""")
def sync_summary(o, n):
    return ingest.sync_summary(sync.listing_diff(sync.with_hash(o), sync.with_hash(n)), sync.stale_keys(o, n))


@query("missed_keys", "listing_old", "listing_new", sql="SELECT jira_key FROM listing_new WHERE jira_key NOT IN (SELECT jira_key FROM listing_old)")
def missed_keys(o, n):
    return n.select("jira_key").subtract(o.select("jira_key"))


@query("corpus_union", "listing_old", "prd_chunks", sql="SELECT jira_key AS id, summary AS text, 'test' AS kind FROM listing_old UNION ALL SELECT source_id || '#' || chunk_index::VARCHAR, chunk_text, 'chunk' FROM prd_chunks")
def corpus_union(o, c):
    tests = o.select(F.col("jira_key").alias("id"), F.col("summary").alias("text"), F.lit("test").alias("kind"))
    return tests.unionByName(c.select(F.concat("source_id", F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk_text").alias("text"), F.lit("chunk").alias("kind")))


@query("gap_summary", "decisions", sql="""WITH m AS (SELECT CASE WHEN count(*) FILTER (WHERE action IN ('keep', 'update')) > 0 THEN 'covered' WHEN count(*) FILTER (WHERE action = 'create') > 0 THEN 'unverified' WHEN count(*) FILTER (WHERE action = 'deprecate') > 0 THEN 'shrinking' ELSE 'questioned' END AS gap_risk FROM decisions GROUP BY prd_source, prd_section)
    SELECT g AS gap_risk, (SELECT count(*) FROM m WHERE m.gap_risk = g) AS n FROM (SELECT unnest(['covered', 'unverified', 'shrinking', 'questioned', 'uncovered']) AS g)""")
def gap_summary(d):
    """Sections by gap, zeros included."""
    kinds = ("covered", "unverified", "shrinking", "questioned", "uncovered")
    wide = review.coverage(d).agg(*[F.count_if(F.col("gap_risk") == k).alias(k) for k in kinds])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gap_risk"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


@query("bulk_diagnostics", "test_cases", sql="SELECT count(*) FILTER (WHERE coalesce(steps_text, '') = '') AS n_no_steps, round(avg(length(coalesce(steps_text, ''))), 3)::DOUBLE AS avg_steps_chars FROM test_cases")
def bulk_diagnostics(t):
    steps = F.coalesce("steps_text", F.lit(""))
    return t.agg(F.count_if(steps == "").alias("n_no_steps"), F.round(F.avg(F.length(steps)), 3).alias("avg_steps_chars"))


@query("table_counts", "decisions", "runs", sql="SELECT 'decisions' AS name, count(*) AS n FROM decisions UNION ALL SELECT 'runs', count(*) FROM runs")
def table_counts(d, r):
    return d.agg(F.count("*").alias("n")).select(F.lit("decisions").alias("name"), "n").unionByName(r.agg(F.count("*").alias("n")).select(F.lit("runs").alias("name"), "n"))


@query("reservoir", "webhook_events", sql="SELECT event_id FROM (SELECT event_id, event, row_number() OVER (PARTITION BY event ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY event) AS n FROM webhook_events) WHERE n <= 10000 OR r <= 5000")
def reservoir(e):
    """Of each series the last 5,000 once it has over 10,000."""
    return review.reservoir(e, "event", ["ts", "event_id"]).select("event_id")


@query("ci_gate", "ground_truth", sql=f"""WITH m AS ({ORACLE_METRICS}), a AS (SELECT round(avg(recall), 4)::DOUBLE AS recall, round(avg(precision), 4)::DOUBLE AS precision, round(avg(mrr), 4)::DOUBLE AS mrr, round(avg(ndcg), 4)::DOUBLE AS ndcg FROM m)
    SELECT *, concat_ws(',', CASE WHEN recall < 0.6 THEN 'recall' END, CASE WHEN mrr < 0.4 THEN 'mrr' END, CASE WHEN ndcg < 0.4 THEN 'ndcg' END) AS failed, recall >= 0.6 AND mrr >= 0.4 AND ndcg >= 0.4 AS passes FROM a""")
def ci_gate(g):
    """Macro averages of the metrics against their thresholds."""
    return review.gate(ir_metrics(g))


@query("token_usage", "calls", sql="""WITH t AS (SELECT run_id, model, coalesce(sum(input_tokens), 0)::BIGINT AS i, coalesce(sum(output_tokens), 0)::BIGINT AS o, coalesce(sum(cache_read_tokens), 0)::BIGINT AS r, coalesce(sum(cache_write_tokens), 0)::BIGINT AS w, count(*) AS calls, count(input_tokens) AS reported FROM calls GROUP BY ALL)
    SELECT run_id, model, i AS input_tokens, o AS output_tokens, calls, CASE model WHEN 'small' THEN round(((i + 0.1::DOUBLE * r + 1.25::DOUBLE * w) * 1 + 5.0::DOUBLE * o) / 1000000, 4) WHEN 'large' THEN round(((i + 0.1::DOUBLE * r + 1.25::DOUBLE * w) * 3 + 15.0::DOUBLE * o) / 1000000, 4) END AS cost,
      CASE WHEN i + r > 0 THEN round(r / (i + r), 3)::DOUBLE END AS cache_hit_ratio, reported < calls AS lower_bound FROM t""")
def token_usage(c):
    prices = c.sparkSession.createDataFrame([("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, in_price double, out_price double")
    return ingest.usage_totals(c, prices)


@query("relative_cut", "ground_truth", sql="""WITH r AS (SELECT query, doc_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM ground_truth), g AS (SELECT *, score - lead(score) OVER (PARTITION BY query ORDER BY pos) AS gap FROM r),
    s AS (SELECT query, count(*) AS n, arg_max(pos, {'a': gap, 'b': -pos}) FILTER (WHERE gap IS NOT NULL) AS knee, max(gap) AS kg, median(gap) AS mg FROM g GROUP BY query),
    k AS (SELECT query, greatest(CASE WHEN n > 1 AND round(CASE WHEN mg > 1e-12 THEN kg / mg ELSE 0 END, 2) >= 3 THEN coalesce(knee, 0) + 1 ELSE n END, least(3, n)) AS kept FROM s)
    SELECT query, doc_id FROM g JOIN k USING (query) WHERE pos < kept""")
def relative_cut(g):
    from pyspark.sql import Window

    scores = g.select("query", F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("key"))
    ranked = g.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id")) - 1)
    return search.relative_cut(ranked.select("query", "doc_id", "pos"), search.separation(scores, "query"), "query").select("query", "doc_id")


@query("module_of_folder", "listing_new", sql="SELECT jira_key, nullif(string_split(trim('/' || replace(label_b, ' ', '/') || '/', '/'), '/')[1], '') AS module FROM listing_new")
def module_of_folder(n):
    return n.select("jira_key", T.folder_module(F.concat(F.lit("/"), F.regexp_replace("label_b", " ", "/"), F.lit("/"))).alias("module"))


@query("format_chunk", "prd_chunks", sql=f"SELECT source_id, chunk_index, substring(CASE WHEN heading IS NOT NULL THEN '[' || heading || ']' || chr(10) ELSE '' END || chunk_text, 1, 8000) AS text FROM ({_INHERITED})")
def format_chunk(c):
    return sync.inherited(c).select("source_id", "chunk_index", T.chunk_text(F.col("heading"), F.col("chunk_text")).alias("text"))


@query("percentiles", "ground_truth", sql="SELECT query, quantile_cont(n_chars, 0.3) AS p30, quantile_cont(n_chars, 0.95) AS p95 FROM ground_truth GROUP BY query")
def percentiles(g):
    return g.groupBy("query").agg(F.percentile("n_chars", 0.3).alias("p30"), F.percentile("n_chars", 0.95).alias("p95"))


# ---- sections, titles, answers, runs ----

_SECTIONED = """SELECT *, CASE chunk_index % 15 WHEN 0 THEN '1. Building:' WHEN 3 THEN 'MACHINERY' WHEN 6 THEN 'Appendix B' WHEN 9 THEN ' household ' ELSE section_heading END AS heading_now, CASE WHEN chunk_text LIKE '%|%' THEN 'table' WHEN chunk_index % 4 = 0 THEN NULL ELSE 'prose' END AS chunk_type FROM prd_chunks"""


def _sectioned(c):
    now = F.expr("CASE chunk_index % 15 WHEN 0 THEN '1. Building:' WHEN 3 THEN 'MACHINERY' WHEN 6 THEN 'Appendix B' WHEN 9 THEN ' household ' ELSE section_heading END")
    kind = F.expr("CASE WHEN chunk_text LIKE '%|%' THEN 'table' WHEN chunk_index % 4 = 0 THEN NULL ELSE 'prose' END")
    return coverage.section_list(c.withColumns({"section_heading": now, "chunk_type": kind}))


_BARE_HEADING = f"trim(regexp_replace(trim(coalesce(heading, '')), '{T.HEADING_PREFIX}', ''))"
_LIST = f"""s0 AS (SELECT *, coalesce(last_value(nullif(trim(heading_now), '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING), '(no heading)') AS heading FROM ({_SECTIONED})),
    s1 AS (SELECT source_id, heading, min(chunk_index) AS first, sum(len(list_filter(regexp_split_to_array(trim(chunk_text), '\\s+'), lambda x: x <> '')))::BIGINT AS n_words, coalesce(string_agg(DISTINCT chunk_type, '/' ORDER BY chunk_type), '?') AS kinds FROM s0 GROUP BY source_id, heading),
    s AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY first, heading) AS INTEGER) AS no, heading, n_words, kinds, NOT regexp_matches({_BARE_HEADING}, '(?i)^(?:{'|'.join(T.META_HEADINGS)})') AS testable FROM s1),
    t AS (SELECT source_id, no, heading, {_NORMAL.replace("%s", "heading")} AS key FROM s WHERE testable)"""


@query("section_list", "prd_chunks", sql=f"WITH {_LIST} SELECT * FROM s")
def section_list(c):
    return _sectioned(c)


_COUNTED = ", ".join([*(f"count(*) FILTER (WHERE action = '{a}') AS {a}_count" for a in review.ACTIONS), "count(*) FILTER (WHERE approved) AS approved_count", "count(*) FILTER (WHERE NOT reviewed) AS pending_count", "count(*) FILTER (WHERE written_back) AS written_count"])


@query("section_coverage", "prd_chunks", "decisions", sql=f"""WITH {_LIST}, d AS (SELECT prd_source AS source_id, lower(prd_section) AS key, {_COUNTED} FROM decisions GROUP BY ALL)
    SELECT source_id, no, heading, {", ".join(f"coalesce({c}, 0) AS {c}" for c in coverage.COUNTS)}, CASE WHEN keep_count > 0 OR update_count > 0 THEN 'covered' WHEN create_count > 0 THEN 'unverified' WHEN deprecate_count > 0 THEN 'shrinking' WHEN question_count > 0 THEN 'questioned' ELSE 'uncovered' END AS gap_risk
    FROM t LEFT JOIN d USING (source_id, key)""")
def section_coverage(c, d):
    return coverage.section_coverage(_sectioned(c), d)[0]


@query("unmatched_labels", "prd_chunks", "decisions", sql=f"""WITH {_LIST} SELECT prd_source AS source_id, min(prd_section) AS label FROM decisions WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = prd_source AND t.key = lower(prd_section)) GROUP BY prd_source, lower(prd_section)""")
def unmatched_labels(c, d):
    return coverage.section_coverage(_sectioned(c), d)[1]


@query("coverage_scores", "prd_chunks", "decisions", sql=f"""WITH {_LIST}, a AS (SELECT DISTINCT source_id, key FROM t WHERE key <> ''), b AS (SELECT DISTINCT prd_source AS source_id, lower(prd_section) AS key FROM decisions WHERE action IN ('keep', 'update', 'create')),
    n AS (SELECT source_id, count(*) AS n_testable, count(*) FILTER (WHERE key IN (SELECT key FROM b WHERE b.source_id = a.source_id)) AS n_covered FROM a GROUP BY source_id),
    u AS (SELECT source_id, string_agg(key, ',' ORDER BY key) AS unmatched FROM b ANTI JOIN a USING (source_id, key) GROUP BY source_id)
    SELECT source_id, coalesce(n_testable, 0) AS n_testable, coalesce(n_covered, 0) AS n_covered, CASE WHEN n_testable > 0 THEN round(n_covered / n_testable, 3)::DOUBLE END AS coverage_score, coalesce(unmatched, '') AS unmatched FROM (SELECT DISTINCT source_id FROM s) LEFT JOIN n USING (source_id) LEFT JOIN u USING (source_id)""")
def coverage_scores(c, d):
    return coverage.coverage_scores(_sectioned(c), d).withColumn("unmatched", F.array_join("unmatched", ","))


def _titled_sql(kind: str) -> str:
    if kind == "other":
        return "NOT (" + " OR ".join(_titled_sql(k) for k in guards.TITLE_PHRASES) + ")"
    found = [f"contains({_PHRASE.replace('%s', 'title')}, ' {p} ')" for p in guards.TITLE_PHRASES[kind]]
    return "(" + " OR ".join(found + ([f"regexp_matches(title, '{guards.VERSION_TITLE}')"] if kind == "release_note" else [])) + ")"


@query("title_filter", "titles", sql=f"""SELECT doc_id, {_titled_sql('prd')} OR {_titled_sql('release_note')} AS named, ({_titled_sql('other')} OR {_titled_sql('test_plan')}) AND NOT {_titled_sql('prd')} AS mixed, NOT ({_titled_sql('meeting_note')} OR {_titled_sql('tech_doc')}) AS rest FROM titles""")
def title_filter(t):
    f = lambda *a: guards.title_filter(F.col("title"), *a)
    return t.select("doc_id", f(("prd", "release_note", "unknown")).alias("named"), f(("other", "test_plan"), ("prd",)).alias("mixed"), f((), ("meeting_note", "tech_doc", "other")).alias("rest"))


@query("run_lifecycle", "runs", sql="""WITH q AS (SELECT run_id, run_no, status, CASE run_no % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' ELSE 'reopen' END AS request, CASE run_no % 3 WHEN 0 THEN 'truncated' WHEN 1 THEN 'nonsense' END AS goal FROM runs),
    a AS (SELECT *, CASE WHEN request = 'start' AND status = 'failed' THEN 'running' WHEN request = 'complete' AND status = 'running' THEN CASE WHEN goal = 'truncated' THEN 'truncated' ELSE 'completed' END WHEN request = 'fail' AND status = 'running' THEN 'failed' WHEN request = 'reopen' AND status = 'failed' THEN 'running' END AS after FROM q)
    SELECT run_id, coalesce(after, status) AS status, after IS NOT NULL AS changed FROM a UNION ALL SELECT 'new-' || run_id, 'running', true FROM q WHERE run_no % 10 = 0""")
def run_lifecycle(r):
    ask = F.expr("CASE run_no % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' ELSE 'reopen' END")
    known = r.select("run_id", ask.alias("request"), F.expr("CASE run_no % 3 WHEN 0 THEN 'truncated' WHEN 1 THEN 'nonsense' END").alias("to"))
    new = r.where("run_no % 10 = 0").select(F.concat(F.lit("new-"), "run_id").alias("run_id"), F.lit("start").alias("request"), F.lit(None).cast("string").alias("to"))
    lost = new.select(F.concat(F.lit("lost-"), "run_id").alias("run_id"), F.lit("fail").alias("request"), "to")
    return review.run_lifecycle(r, known.unionByName(new).unionByName(lost))


@query("decision_page_total", "decisions", sql="SELECT id, run_id, (SELECT count(*) FROM decisions) AS total FROM decisions ORDER BY created_at, id LIMIT 1 OFFSET 0")
def decision_page_total(d):
    return review.page_with_total(d, 0, -5).select("id", "run_id", "total")


_ASK = f"""{_CHUNKS % ''}, o AS (SELECT query_id, key_no, chunk_no, source_id, score, rank - 1 AS pos FROM hits WHERE score >= 0.6), g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY pos) AS gap FROM o),
    z AS (SELECT query_id, count(*) AS n, arg_max(pos, {{'a': gap, 'b': -pos}}) FILTER (WHERE gap IS NOT NULL) AS knee, max(gap) AS kg, median(gap) AS mg FROM g GROUP BY query_id),
    k AS (SELECT query_id, greatest(CASE WHEN n > 1 AND round(CASE WHEN mg > 1e-12 THEN kg / mg ELSE 0 END, 2) >= 3 THEN coalesce(knee, 0) + 1 ELSE n END, least(3, n)) AS kept FROM z),
    p AS (SELECT query_id, key_no, chunk_no, source_id, score, CAST(pos + 1 AS INTEGER) AS n FROM g JOIN k USING (query_id) WHERE pos < kept)"""


def _passages(t, c):
    hits = _hits(t, c).join(c.select("chunk_no", "source_id", "section_heading", "doc_title"), "chunk_no")
    numbered = hits.select("query_id", F.col("chunk_no").alias("key"), "score", F.col("doc_title").alias("title"), F.col("section_heading").alias("heading"), F.concat("source_id", F.lit(" <|system|> text")).alias("text"))
    return answers.passages(numbered, 8, least=0.6)


@query("ask_context", "test_cases", "prd_vectors", sql=f"""WITH {_ASK} SELECT query_id, count(*) AS n_passages, string_agg('[' || n::VARCHAR || '] ' || doc_title || ' › ' || section_heading || chr(10) || v.source_id || ' [FILTERED] text', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM p JOIN prd_vectors v USING (chunk_no) GROUP BY query_id""")
def ask_context(t, c):
    """What a model is given for each question."""
    return answers.contexts(_passages(t, c))


@query("ask_grounding", "test_cases", "prd_vectors", sql=f"""WITH {_ASK}, m AS (SELECT query_id, q.key_no, coalesce(max(n), 0) AS most FROM q LEFT JOIN p USING (query_id) GROUP BY ALL),
    x AS (SELECT *, CASE key_no % 3 WHEN 0 THEN list_filter([1, 2, 99, key_no % 11], lambda i: i BETWEEN 1 AND most) WHEN 1 THEN [] ELSE list_filter([1], lambda i: i <= most) END AS c, most = 0 OR key_no % 3 = 2 AS a FROM m)
    SELECT query_id, array_to_string(list_sort(list_distinct(c)), ',') AS cited, a AS abstained, len(c) > 0 AND NOT a AS grounded FROM x""")
def ask_grounding(t, c):
    """What answers cite: some passages twice or that don't exist, none at all, or one while saying that nothing is documented."""
    answer = F.expr("CASE key_no % 3 WHEN 0 THEN '<think>[4]</think>See [2], [1], [2], [99] and [' || CAST(key_no % 11 AS STRING) || '].' WHEN 1 THEN 'No source [x].' ELSE 'Not documented, but see [1].' END")
    said = t.where(F.col("key_no") % EVERY == 0).select(F.col("jira_key").alias("query_id"), answer.alias("answer"))
    return answers.grounded(said, _passages(t, c)).withColumn("cited", F.array_join("cited", ","))


# ---- documents as they are read and judged ----

_BLOCKS = f"""b0 AS (SELECT source_id, coalesce(heading, '(no heading)') AS heading, chunk_index, chunk_text FROM ({_INHERITED})),
    b1 AS (SELECT source_id, heading, min(chunk_index) AS first, string_agg(coalesce(chunk_text, ''), chr(10) || chr(10) ORDER BY chunk_index) AS body FROM b0 GROUP BY source_id, heading),
    b AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first, heading) AS no, heading, block, greatest(1, length(block) // 4) AS tokens FROM (SELECT *, CASE WHEN heading = '(no heading)' THEN body ELSE '### ' || heading || chr(10) || body END AS block FROM b1))"""


@query("read_documents", "prd_chunks", sql=f"""WITH {_BLOCKS}, f AS (SELECT source_id, count(*) AS n, '# ' || source_id || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY no) AS full_text,
      string_agg('  ' || no::VARCHAR || '. ' || heading || '  (~' || format('{{:,}}', tokens) || ' tokens)', chr(10) ORDER BY no) AS outline FROM b GROUP BY source_id),
    h AS (SELECT *, greatest(1, length(full_text) // 4) AS size FROM f), k AS (SELECT *, '# ' || source_id || chr(10) || chr(10) || 'This document is too large to show in full (~' || format('{{:,}}', size) || ' tokens, budget 800).' || chr(10) || 'Outline of all ' || n::VARCHAR || ' sections:' || chr(10) || outline || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS header FROM h),
    r AS (SELECT b.*, sum(tokens) OVER (PARTITION BY source_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS used FROM b), s AS (SELECT r.source_id, count(*) AS shown, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY no) AS opening FROM r JOIN k USING (source_id) WHERE used <= 800 - greatest(1, length(header) // 4) GROUP BY r.source_id)
    SELECT source_id, n AS n_sections, CASE WHEN size <= 800 THEN n ELSE coalesce(shown, 0) END AS n_shown, CASE WHEN size <= 800 THEN full_text ELSE header || coalesce(opening, '') END AS text FROM k LEFT JOIN s USING (source_id)""")
def read_documents(c):
    return documents.read_documents(documents.section_texts(c), 800)


_REQUIRED = f"""rq0 AS (SELECT source_id, {_NORMAL.replace("%s", "heading")} AS key, chunk_index, trim(coalesce(chunk_text, '')) AS t FROM (SELECT * REPLACE (CASE WHEN trim(heading_now) = '' THEN NULL ELSE heading_now END AS heading_now), last_value(nullif(trim(heading_now), '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS heading FROM ({_SECTIONED}))),
    rq AS (SELECT source_id, key, CASE WHEN length(b) > 300 THEN substring(b, 1, 300) || chr(10) || chr(10) || '[…truncated for judge context]' ELSE b END AS requirement FROM (SELECT source_id, key, string_agg(t, chr(10) || chr(10) ORDER BY chunk_index) AS b FROM rq0 WHERE key <> '' AND t <> '' GROUP BY source_id, key))"""


@query("judge_context", "prd_chunks", "decisions", "test_cases", sql=f"""WITH {_REQUIRED} SELECT d.id, concat_ws(chr(10) || chr(10), '## Section' || chr(10) || prd_section, coalesce('## Requirement' || chr(10) || requirement, '## Requirement' || chr(10) || '(No text of this section is indexed: judge by heading and test.)'),
      '## Test: ' || t.jira_key || chr(10) || 'Summary: ' || t.summary || chr(10) || 'Labels: ' || t.lang || ', ' || t.source || chr(10) || 'Steps: ' || substring(coalesce(nullif(t.steps_text, ''), 'N/A'), 1, 500), '## Decision: ' || upper(action), 'Reason: ' || CASE WHEN d.id % 2 = 0 THEN new_summary ELSE 'No reason given' END) AS context
    FROM decisions d LEFT JOIN rq ON rq.source_id = d.prd_source AND rq.key = lower(d.prd_section) LEFT JOIN test_cases t ON t.jira_key = d.jira_key""")
def judge_context(c, d, t):
    now = F.expr("CASE chunk_index % 15 WHEN 0 THEN '1. Building:' WHEN 3 THEN 'MACHINERY' WHEN 6 THEN 'Appendix B' WHEN 9 THEN ' household ' ELSE section_heading END")
    needs = documents.requirement_texts(c.withColumn("section_heading", now), 300)
    said = d.withColumn("reason", F.when(F.col("id") % 2 == 0, F.col("new_summary")).otherwise(""))
    return documents.judge_contexts(said, needs, t.select("jira_key", "summary", "steps_text", F.array("lang", "source").alias("labels")))


_GRADED = """g AS (SELECT decision_id, CASE WHEN correctness IS NOT NULL THEN greatest(1, least(round_even(correctness + 0.5, 0)::INT, 5)) END AS a, CASE WHEN reasoning IS NOT NULL THEN greatest(1, least(reasoning, 5)) END AS b, CASE WHEN completeness IS NOT NULL THEN greatest(1, least(completeness, 5)) END AS c FROM grades),
    r AS (SELECT *, round_even((a * 0.6::DOUBLE + b * 0.25::DOUBLE + c * 0.15::DOUBLE) / 5, 3) AS s FROM g)"""


def _graded(g):
    return documents.graded(g.withColumn("correctness", F.col("correctness") + F.lit(0.5).cast("double")))


@query("graded_decisions", "grades", sql=f"WITH {_GRADED} SELECT decision_id, a AS correctness, b AS reasoning, c AS completeness, s AS rubric_score, concat_ws(',', CASE WHEN c IS NULL THEN 'completeness' END, CASE WHEN a IS NULL THEN 'correctness' END, CASE WHEN b IS NULL THEN 'reasoning' END) AS missing FROM r")
def graded_decisions(g):
    """Grades with halves, which round to even."""
    return _graded(g).select("decision_id", "correctness", "reasoning", "completeness", "rubric_score", "missing")


@query("judge_report", "grades", sql=f"WITH {_GRADED} SELECT count(*) FILTER (WHERE s IS NOT NULL) AS evaluated, count(*) FILTER (WHERE s IS NULL) AS incomplete, round(avg(a) FILTER (WHERE s IS NOT NULL), 2)::DOUBLE AS avg_correctness, round(avg(b) FILTER (WHERE s IS NOT NULL), 2)::DOUBLE AS avg_reasoning, round(avg(c) FILTER (WHERE s IS NOT NULL), 2)::DOUBLE AS avg_completeness, round(avg(s), 3)::DOUBLE AS avg_rubric_score FROM r")
def judge_report(g):
    return documents.judge_report(_graded(g))
