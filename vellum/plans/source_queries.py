"""Queries on sources: landed listings, cursors, canonical forms and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import canonical
from vellum.functions.sql import register
from vellum.operators import chunking, review, semantic
from vellum.plans.queries import _TYPES, ORACLE, QUERIES, query
from vellum.sources import listings
from vellum.sources.scratch import new_folder, written
from vellum.streaming.debounce import TRIGGERS

_ITEMS = """SELECT CASE WHEN doc_id % 4 = 3 THEN '~' || source ELSE source END AS listing, CAST(floor(doc_id / 500) AS INT) AS page, CAST(doc_id AS STRING) AS id, 'Page ' || CAST(doc_id AS STRING) || ' in ' || upper(lang) AS title,
    CAST(doc_id % 5 AS INT) AS version, CASE WHEN doc_id % 10 = 9 THEN 'archived' ELSE 'current' END AS status FROM documents"""


def _landed(spark, sf_dir):
    """All documents as pages of their sources; some pages answer at the third attempt, some never, some with half an answer."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("vellum_landing_documents")
    path, page = new_folder(spark, "landed"), F.col("page") * 3 + F.length("listing")
    busy = F.lit('{"status": 429, "error": "Too many requests"}')
    answers = (
        F.when(page % 13 == 5, F.array(F.lit('{"status": 404, "error": "Not found"}'), "ok"))
        .when(page % 11 == 6, F.array(F.lit('{"status": 503, "error": "Service unavailable"}')))
        .when(page % 17 == 8, F.array(F.expr("substring(ok, 1, length(ok) - 9)"))).when(page % 7 == 3, F.array(busy, busy, "ok")).otherwise(F.array("ok"))
    )
    listings.land(spark.sql(_ITEMS.replace("FROM documents", "FROM vellum_landing_documents")), path, answers)
    listings.register(spark)
    return path


def paged_listing(spark, sf_dir):
    """Current pages of shared spaces, and every page of a listing that could not be had."""
    path = _landed(spark, sf_dir)
    read = lambda mode: spark.read.format("paged_listing").option("mode", mode).option("title_filter", " IN e").load(path)
    items = listings.first_seen(read("items").where("status = 'current'")).select("listing", "page", "id", "title", "version", "attempts", F.lit("ok").alias("outcome"))
    none = F.lit(None)
    return items.unionByName(read("failures").select("listing", "page", none.cast("string").alias("id"), none.cast("string").alias("title"), none.cast("int").alias("version"), "attempts", "outcome"))


QUERIES["paged_listing"] = paged_listing
ORACLE["paged_listing"] = f"""WITH i AS ({_ITEMS}), s AS (SELECT * FROM i WHERE listing NOT LIKE '~%'),
    n AS (SELECT *, page * 3 + length(listing) AS n FROM s), p AS (SELECT *, CASE WHEN n % 13 = 5 THEN 'permanent' WHEN n % 11 = 6 THEN 'exhausted' WHEN n % 17 = 8 THEN 'permanent' ELSE 'ok' END AS outcome, CASE WHEN n % 13 = 5 THEN 1 WHEN n % 11 = 6 THEN 4 WHEN n % 17 = 8 THEN 1 WHEN n % 7 = 3 THEN 3 ELSE 1 END AS attempts FROM n)
    SELECT listing, page, id, title, version, attempts, outcome FROM p WHERE outcome = 'ok' AND status = 'current' AND contains(lower(title), ' in e')
    UNION ALL SELECT DISTINCT listing, page, NULL, NULL, NULL, attempts, outcome FROM p WHERE outcome <> 'ok'"""


# ---- canonical forms, ledgers, signatures, cursors, SQL functions ----

_ENTRY = ("id", "jira_key", "action", "prd_section", "confidence", "reviewed")
_JSON = "'{\"action\":\"' || action || '\",\"confidence\":' || coalesce('\"' || confidence || '\"', 'null') || ',\"id\":' || id || ',\"jira_key\":\"' || jira_key || '\",\"prd_section\":\"' || prd_section || '\",\"reviewed\":' || reviewed || '}'"


@query("run_fingerprints", "decisions", sql=f"SELECT run_id, count(*) AS n, sha256('[' || string_agg({_JSON}, ',' ORDER BY id) || ']') AS fingerprint FROM decisions GROUP BY run_id")
def run_fingerprints(d):
    return canonical.fingerprints(d.select("run_id", "id", canonical.canonical_row(*_ENTRY).alias("entry")), "run_id", "id", "entry")


@query("ledger_chain", "decisions", sql=f"""SELECT run_id, count(*) AS n, list_reduce(list_prepend('', list({_JSON} ORDER BY id)), lambda a, x: sha256(a || x)) AS last_hash, 0::BIGINT AS n_broken FROM decisions GROUP BY run_id""")
def ledger_chain(d):
    """Each run's decisions as a chained ledger: its last hash, and how many links are broken (none)."""
    chain = canonical.chained(d.select("run_id", "id", canonical.canonical_row(*_ENTRY).alias("entry")), "run_id", "id", "entry")
    broken = canonical.broken_links(chain, "run_id", "id", "entry").groupBy("run_id").agg(F.count("*").alias("n_broken"))
    last = chain.groupBy("run_id").agg(F.count("*").alias("n"), F.max_by("hash", "id").alias("last_hash"))
    return last.join(broken, "run_id", "left").select("run_id", "n", "last_hash", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))


@query("signed_events", "webhook_events", sql="""SELECT event_id, event, CASE WHEN event_id % 11 <> 4 THEN page_id::VARCHAR END AS page_id, event_id % 7 <> 3 AND event_id % 13 <> 6 AND event IN ('page_updated', 'page_created', 'page_restored') AND event_id % 11 <> 4 AS accepted FROM webhook_events""")
def signed_events(e):
    """Events with signed bodies: some signed with another key, some without a signature, some of a page that is no number."""
    n = F.col("event_id")
    page = F.when(n % 11 == 4, F.concat(F.lit("x"), "page_id")).otherwise(F.col("page_id").cast("string"))
    body = F.when(n % 2 == 0, F.to_json(F.struct("event", F.struct(page.alias("id")).alias("page")))).otherwise(F.to_json(F.struct(F.col("event").alias("eventType"), F.struct(page.alias("id")).alias("content"))))
    secret, other = F.lit("a secret"), F.lit("another secret")
    sign = F.when(n % 7 == 3, canonical.hmac_sha256(other, F.col("body"))).otherwise(canonical.hmac_sha256(secret, F.col("body")))
    header = F.when(n % 13 == 6, F.lit("")).when(n % 3 == 0, sign).otherwise(F.concat(F.lit("sha256="), sign, F.lit(" ")))
    rows = written(e.withColumn("body", body).withColumn("header", header), "signed")  # as events come in: signed elsewhere
    event, page = canonical.event_name(F.col("body")), canonical.event_page(F.col("body"))
    wanted = event.isin(*TRIGGERS) & page.isNotNull() & canonical.signature_ok(secret, F.col("body"), F.col("header"))
    return rows.select("event_id", event.alias("event"), page.alias("page_id"), F.coalesce(wanted, F.lit(False)).alias("accepted"))


@query("keyset_page", "decisions", sql="SELECT id, run_id, action FROM decisions WHERE id > 1000 ORDER BY id LIMIT 500")
def keyset_page(d):
    return review.keyset_page(d, 1000, 500).select("id", "run_id", "action")


def chunks_lateral(spark, sf_dir):
    """Chunks of all documents through SQL."""
    register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("vellum_sql_documents")
    return spark.sql("SELECT d.doc_id, c.*, vellum_token_count(c.chunk_text) AS n_tokens FROM vellum_sql_documents d, LATERAL chunk_document(d.text) c")


QUERIES["chunks_lateral"] = chunks_lateral  # held to chunk_fixed


@query("sql_functions", "titles", sql=f"SELECT doc_id, greatest(1, length(title) // 4) AS n_tokens, CASE {_TYPES} ELSE 'other' END AS doc_type FROM titles")
def sql_functions(t):
    register(t.sparkSession)
    return t.select("doc_id", F.expr("vellum_token_count(title)").alias("n_tokens"), F.expr("vellum_doc_type(title)").alias("doc_type"))


# ---- semantic chunking ----

_LETTERS = "enirstal"


def _vector(text: str) -> str:
    return ", ".join(f"CAST(length({text}) - length(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in _LETTERS)


@query(
    "semantic_groups", "prd_chunks",
    sql=f"""WITH RECURSIVE s AS (SELECT source_id, chunk_index AS k, CASE WHEN contains(chunk_text, '|') THEN 'table' ELSE 'prose' END AS kind, greatest(1, length(chunk_text) // 4) AS n, [{_vector("chunk_text")}] AS v FROM prd_chunks),
    p AS (SELECT *, lag(v) OVER w AS u, lag(kind) OVER w AS was FROM s WINDOW w AS (PARTITION BY source_id ORDER BY k)),
    c AS (SELECT source_id, k, n, CASE WHEN kind = 'prose' AND was = 'prose' THEN round(CASE WHEN sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) >= 1e-16 THEN list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) ELSE 0 END, 6) ELSE 1 END AS sim FROM p),
    t AS (SELECT source_id, coalesce(round(quantile_cont(sim, 0.3) FILTER (WHERE sim < 1), 6), -1) AS threshold, count(*) <= 2 OR sum(n) <= 100 AS whole FROM c GROUP BY source_id),
    x AS (SELECT source_id, k, n, sim < threshold AS dips, whole FROM c JOIN t USING (source_id)),
    f AS (SELECT source_id, k, n, n AS size, 0 AS g FROM x WHERE k = 0 UNION ALL
      SELECT x.source_id, x.k, x.n, CASE WHEN NOT whole AND ((dips AND f.size >= 100) OR f.size + x.n > 1200) THEN x.n ELSE f.size + x.n END, f.g + CASE WHEN NOT whole AND ((dips AND f.size >= 100) OR f.size + x.n > 1200) THEN 1 ELSE 0 END
      FROM f JOIN x ON x.source_id = f.source_id AND x.k = f.k + 1),
    o AS (SELECT *, (g > 0 AND sum(n) OVER (PARTITION BY source_id, g) >= 100 AND k = min(k) OVER (PARTITION BY source_id, g))::INT AS opens FROM f)
    SELECT source_id, k AS seg_no, CAST(sum(opens) OVER (PARTITION BY source_id ORDER BY k) AS INTEGER) AS chunk_no FROM o""",
)
def semantic_groups(c):
    """Lines of all documents as segments, their letters as vectors."""
    kind = F.when(F.contains("chunk_text", F.lit("|")), "table").otherwise("prose")
    vector = F.expr(f"array({_vector('chunk_text')})")
    rows = c.select("source_id", F.lit(0).alias("section_no"), F.col("chunk_index").alias("seg_no"), kind.alias("kind"), F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 4)).cast("int").alias("n_tokens"), vector.alias("embedding"))
    return semantic.semantic_groups(rows).select("source_id", "seg_no", "chunk_no")


ORACLE["semantic_groups"] = ORACLE["semantic_groups"].replace("WITH prd_chunks", "WITH RECURSIVE prd_chunks", 1).replace(", RECURSIVE s AS", ", s AS")


def semantic_chunks(spark, sf_dir):
    """Documents by sections and segments, hashed embeddings of the segments, chunks."""
    segments = semantic.segment_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return semantic.semantic_chunks(segments.withColumn("embedding", chunking.hashed_vector(F.col("text"))))


QUERIES["semantic_chunks"] = semantic_chunks  # a fold over vectors: held to brute force
