"""The engine in SQL: a table function that chunks documents, and scalar functions.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_document(d.text) c"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vellum.functions import text as T
from vellum.operators.chunking import MAX_TOKENS, chunks

# name, parameters, type, body: plain SQL, so Catalyst inlines them
SCALARS = (
    ("vellum_token_count", "t STRING", "BIGINT", "greatest(1L, CAST(floor(length(t) / 4) AS BIGINT))"),
    ("vellum_confidence", "c STRING", "STRING", "CASE WHEN lower(trim(c)) IN ('high', 'medium', 'low') THEN lower(trim(c)) END"),
    ("vellum_page_id", "s STRING", "STRING", "CASE WHEN s RLIKE '^[0-9]+$' THEN s ELSE regexp_extract(s, '/pages/([0-9]+)', 1) END"),
    ("vellum_heading", "h STRING", "STRING", "trim(lower(regexp_replace(regexp_replace(trim(regexp_replace(trim(coalesce(h, '')), {prefix}, '')), {space}, ' '), {tail}, '')))"),
    ("vellum_doc_type", "title STRING", "STRING", "CASE {types} ELSE 'other' END"),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Makes ``chunk_document`` and the ``vellum_*`` functions known to the session's SQL."""

    class ChunkDocument:
        def eval(self, document: str):
            for k, c in enumerate(chunks(document or "", MAX_TOKENS)):
                yield k, c["section_heading"], c["chunk_text"], c["chunk_type"]

    spark.udtf.register("chunk_document", udtf(ChunkDocument, returnType="chunk_index int, section_heading string, chunk_text string, chunk_type string", useArrow=True))
    types = " ".join(f"WHEN title RLIKE {_quoted(f'(?i)(?:{pattern})')} THEN '{name}'" for name, pattern in T.DOC_TYPES)
    parts = {"prefix": _quoted(T.HEADING_PREFIX), "tail": _quoted(T.HEADING_TAIL), "space": _quoted(r"\s+"), "types": types}
    for name, parameters, kind, body in SCALARS:
        for k, v in parts.items():
            body = body.replace("{" + k + "}", v)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
