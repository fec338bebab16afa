"""Canonical JSON, fingerprints of ordered lists, chained ledgers, and HMAC signatures."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIGGER_SPELLINGS = ("event", "eventType")


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every level, no spaces, and all but ASCII escaped; null where it isn't JSON.

    Numbers and escapes are those of Python's ``json``, byte for byte, which no JVM function gives; rows go in Arrow batches."""

    @F.pandas_udf("string")
    def canonical(rows: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
            except (ValueError, TypeError, RecursionError):
                return None

        return rows.map(one)

    return canonical(text)


def canonical_row(*columns: str) -> Column:
    """Columns as a canonical JSON object, null values included."""
    return canonical_json(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def fingerprints(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``<key>, n, fingerprint``: SHA-256 of each key's canonical texts as one JSON list, in this order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), 256).alias("fingerprint"))


def chained(entries: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Entries (one list a key) with ``previous`` and ``hash``: each hash covers the entry and the hash before it, so no entry can be
    changed, dropped or moved without all later hashes telling. The first ``previous`` is ''."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))

    def link(acc: Column, e: Column) -> Column:
        before = F.coalesce(F.get(acc, F.size(acc) - 1)["hash"], F.lit(""))
        return F.concat(acc, F.array(F.struct(e[order].alias(order), e[text].alias(text), before.alias("previous"), F.sha2(F.concat(before, e[text]), 256).alias("hash"))))

    kinds = {c: entries.schema[c].dataType.simpleString() for c in (order, text)}
    empty = F.array().cast(f"array<struct<{order}:{kinds[order]},{text}:{kinds[text]},previous:string,hash:string>>")
    chains = entries.groupBy(key).agg(F.aggregate(listed, empty, link).alias("chain"))
    return chains.select(key, F.explode("chain").alias("e")).select(key, "e.*")


def broken_links(ledger: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Entries whose hash or previous hash is not what the entries before make it."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    rows = ledger.withColumn("before", before)
    wrong = (F.col("previous") != F.col("before")) | (F.col("hash") != F.sha2(F.concat("previous", F.col(text)), 256))
    return rows.where(F.coalesce(wrong, F.lit(True))).drop("before")


def _padded(key: Column, byte: int) -> Column:
    """The key's 64 bytes, each xor ``byte``, four at a time; ``key`` is hexadecimal, of 128 digits. A literal key is folded by the optimizer."""
    part = lambda i: F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(byte * 0x01010101))
    return F.unhex(F.concat(*[F.lpad(F.hex(part(i)), 8, "0") for i in range(16)]))


def hmac_sha256(secret: Column, body: Column) -> Column:
    """HMAC-SHA256 in lower-case hexadecimal; texts count as UTF-8. Keys over 64 bytes are hashed first."""
    key, body = secret.cast("binary"), body.cast("binary")
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    key = F.rpad(F.hex(short), 128, "0")
    inner = F.sha2(F.concat(_padded(key, 0x36), body), 256)
    return F.sha2(F.concat(_padded(key, 0x5C), F.unhex(inner)), 256)


def signature_ok(secret: Column, body: Column, header: Column) -> Column:
    """Whether the header signs the body; with or without the algorithm's name before ``=``. An empty secret or header never does.
    Digests are compared by their hashes, so that the time taken says nothing of where they differ."""
    given = F.trim(F.when(F.contains(header, F.lit("=")), F.regexp_replace(header, "^[^=]*=", "")).otherwise(header))
    same = F.sha2(hmac_sha256(secret, body), 256) == F.sha2(given, 256)
    return F.coalesce((F.octet_length(secret) > 0) & (F.octet_length(header) > 0) & same, F.lit(False))


def event_name(payload: Column) -> Column:
    """The event of a JSON payload, under either spelling; '' if it has none."""
    named = [F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in TRIGGER_SPELLINGS]
    return F.trim(F.coalesce(*named, F.lit("")))


def event_page(payload: Column) -> Column:
    """The page id of a JSON payload, from its page or its content; null unless it is all digits."""
    found = F.trim(F.coalesce(F.get_json_object(payload, "$.page.id"), F.get_json_object(payload, "$.content.id")))
    return F.when(found.rlike("^[0-9]+$"), found)
