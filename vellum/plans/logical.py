"""Logical tables of the review engine over the bundled test tables, one SQL text for both engines.

Entries are plain SQL that Spark and DuckDB both run; where array syntax differs there are two."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ACTION = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'update' WHEN '2' THEN 'deprecate' WHEN '3' THEN 'keep' WHEN '4' THEN 'create' ELSE 'question' END"

LOGICAL: dict[str, str | tuple[str, str]] = {
    "test_cases": """
        SELECT 'PROJ-' || CAST(vec_id AS STRING) AS jira_key, vec_id AS key_no, substring(text, 1, 120) AS summary,
          CASE WHEN vec_id % 3 <> 0 THEN substring(text, 121, 400) ELSE substring(text, 121) END AS description,
          CASE WHEN vec_id % 3 <> 0 THEN substring(text, 521) END AS steps_text,
          CASE WHEN label <> 0 THEN 'M' || CAST(label AS STRING) END AS module, lang, source, embedding
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "decisions": f"""
        SELECT o_orderkey AS id, o_custkey AS run_no, CAST(o_custkey AS STRING) AS run_id, 'PROJ-' || CAST(o_custkey % 500 AS STRING) AS jira_key, {_ACTION} AS action, 'Proposal ' || CAST(o_orderkey % 3 AS STRING) AS new_summary,
          'doc:' || CAST(o_custkey % 100 AS STRING) AS prd_source, c_mktsegment AS prd_section,
          CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence,
          o_orderstatus <> 'O' AS reviewed, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS approved,
          (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS written_back, o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "proposals": f"""
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'drop' ELSE {_ACTION} END AS action, CASE WHEN o_orderkey % 5 <> 0 THEN 'PROJ-' || CAST(o_orderkey % 700 AS STRING) END AS jira_key,
          CASE o_orderkey % 4 WHEN 0 THEN 'too short' WHEN 1 THEN 'the feature was removed from the product last year' ELSE 'this section still describes what the test checks' END AS reason,
          CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'change step 2' ELSE '  ' END END AS suggested_changes,
          CASE WHEN o_orderkey % 7 <> 0 THEN 'new test' END AS new_summary, CASE WHEN o_orderkey % 6 <> 0 THEN 'doc:' || CAST(o_custkey % 100 AS STRING) END AS prd_source,
          CASE WHEN o_orderkey % 10 <> 0 THEN 'Part ' || CAST(o_custkey % 5 AS STRING) END AS prd_section, CAST(o_custkey AS STRING) AS run_id,
          CASE o_orderkey % 6 WHEN 0 THEN '[]' WHEN 1 THEN '[{{"action":" open ","result":"shown"}}]' WHEN 2 THEN '[{{"action":"a"}},{{"action":" "}}]' WHEN 3 THEN '[{{"data":"x"}}]'
            WHEN 4 THEN '[{{"action":"go","data":" 1 ","expectedResult":"there"}},{{"action":"stop"}}]' END AS steps_json,
          CASE o_orderkey % 4 WHEN 0 THEN '1. open page -> it shows' || chr(10) || '2) type name | Expected: accepted' || chr(10) || 'a remark' WHEN 1 THEN 'only prose here' WHEN 2 THEN '- first => second => third' || chr(10) || 'Step 3: last' ELSE '* ' END AS outline
        FROM orders""",
    "prd_vectors": """
        SELECT 'doc:' || CAST(vec_id % 40 AS STRING) AS source_id, vec_id AS chunk_no, CASE vec_id % 5 WHEN 0 THEN 'Payments PRD' WHEN 1 THEN 'Implementation plan, payments' WHEN 2 THEN 'v1.2 release'
          WHEN 3 THEN 'Meeting notes' ELSE 'prd-lite: Plan' END AS doc_title, 'section ' || CAST(label AS STRING) AS section_heading, embedding
        FROM embeddings""",
    "calls": """
        SELECT conv_id AS run_id, turn, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, CASE WHEN turn % 4 <> 3 THEN length(text) END AS input_tokens,
          CASE WHEN turn % 4 <> 3 THEN length(text) % 97 END AS output_tokens, CASE WHEN turn % 2 = 1 THEN length(text) % 31 END AS cache_read_tokens, CASE WHEN turn % 5 = 0 THEN length(text) % 13 END AS cache_write_tokens
        FROM conversations""",
    "runs": """
        SELECT CAST(o_custkey AS STRING) AS run_id, o_custkey AS run_no, CASE o_custkey % 4 WHEN 0 THEN 'sync' WHEN 1 THEN 'ingest' ELSE 'analysis' END AS run_type,
          CASE WHEN count(*) >= 20 THEN 'completed' WHEN count(*) >= 10 THEN 'running' ELSE 'failed' END AS status,
          'doc:' || CAST(o_custkey % 100 AS STRING) AS prd_source, count(*) AS decisions_made, min(o_orderdate) AS started_at,
          CASE WHEN count(*) >= 20 THEN max(o_orderdate) END AS completed_at
        FROM orders GROUP BY o_custkey""",
    "listing_old": "SELECT 'T-' || CAST(p_partkey AS STRING) AS jira_key, p_name AS summary, p_brand AS label_a, p_type AS label_b, p_size AS updated FROM part WHERE p_partkey % 13 <> 0",
    "listing_new": """
        SELECT 'T-' || CAST(p_partkey AS STRING) AS jira_key, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' v2' ELSE p_name END AS summary, p_brand AS label_a, p_type AS label_b, p_size AS updated
        FROM part WHERE p_partkey % 17 <> 0""",
    "prd_chunks": (
        """SELECT 'doc:' || CAST(doc_id AS STRING) AS source_id, doc_id, source AS module, CAST(k AS INT) AS chunk_index, line AS chunk_text, CAST(doc_id % 3 AS STRING) AS source_version,
          CASE WHEN k % 3 = 0 THEN array_join(slice(split(trim(line), ' '), 1, 3), ' ') END AS section_heading
        FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS k, line""",
        """SELECT 'doc:' || CAST(doc_id AS STRING) AS source_id, doc_id, source AS module, CAST(k - 1 AS INT) AS chunk_index, lines[k] AS chunk_text, CAST(doc_id % 3 AS STRING) AS source_version,
          CASE WHEN (k - 1) % 3 = 0 THEN array_to_string(list_slice(string_split(trim(lines[k]), ' '), 1, 3), ' ') END AS section_heading
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))""",
    ),
    "webhook_events": """
        SELECT event_id, ts, user_id AS page_id, CASE event_type WHEN 'view' THEN 'page_viewed' WHEN 'click' THEN 'page_updated' WHEN 'signup' THEN 'page_created' WHEN 'purchase' THEN 'page_restored' ELSE '' END AS event
        FROM events""",
    "ground_truth": "SELECT d.doc_id, d.source AS query, d.n_chars, coalesce(l.quality, 0) AS relevant FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "messages": "SELECT conv_id, turn, role, text FROM conversations",
    "grades": "SELECT l_orderkey AS decision_id, CAST(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS INT) % 8 AS correctness, CAST(sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS INT) % 7 AS reasoning, CAST(sum(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS INT) % 6 AS completeness FROM lineitem GROUP BY l_orderkey",
    "titles": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '1. Implementation Plan for ' WHEN 1 THEN 'PRD: ' WHEN 2 THEN '2.1) Tech Design  - ' WHEN 3 THEN 'Release notes v1.2 ' WHEN 4 THEN 'Weekly review ' WHEN 5 THEN 'Regression suite ' WHEN 6 THEN 'Background' WHEN 7 THEN '- Appendix: ' ELSE 'Why this change ' END || CASE WHEN doc_id % 9 <> 6 THEN text ELSE '' END || CASE doc_id % 4 WHEN 0 THEN ' -' WHEN 1 THEN ':' ELSE '' END AS title, text AS body FROM documents",
}


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table; only the base tables that it names are opened, and only its columns read."""
    sql = LOGICAL[name]
    sql = sql if isinstance(sql, str) else sql[0]
    for t in BASE:
        if re.search(table := rf"\b(FROM|JOIN) {t}\b", sql):
            view = f"vellum_{t}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"  # no user's view has this name
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
            sql = re.sub(table, rf"\1 {view}", sql)
    return spark.sql(sql)


def duck(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with these logical tables in front."""
    parts = ", ".join(f"{n} AS ({LOGICAL[n] if isinstance(LOGICAL[n], str) else LOGICAL[n][1]})" for n in names)
    return f"WITH {parts} {sql}" if not sql.lstrip().startswith("WITH ") else f"WITH {parts}, {sql.lstrip()[5:]}"
