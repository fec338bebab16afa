"""Vector code compression (operator 11): product codebooks from Lloyd rounds over distinct part values.

Plan. Components become integers, vectors are cut into ``parts`` equal parts, and equal parts of a position
are counted once: a *distinct* row is (position, value, weight). Lloyd rounds run over these weighted rows
only; a round is one scan with the codebooks in the closure (``parts * entries`` entries, a bound of the
parameters) and one aggregation to as many sums. Codes and errors of the distinct rows are then joined back
to the vectors' parts and gathered by vector.

Skew. A value that one vector in 64 or more has at its position is *hot*: there can be at most 64 of them a
position, so these meet their vectors in a broadcast of at most ``64 * parts`` rows, and all others by a
shuffle in which no key holds more than a 64th of the vectors. Labels' sums return the same way. The weights
come from partial aggregation, so equal vectors never gather.

Defined results: vectors that are null or hold a null or non-finite component are dropped. Shorter vectors
count as padded with zeros to the longest one, rounded up to a multiple of ``parts``; so do empty ones.
Components beyond +-65,536 count as that bound, which keeps all sums in 64 bits. Null ids are kept and come
last where ids are ordered; rows that repeat an id are vectors of their own (equal ids are ordered by their
vectors). With fewer than ``entries`` vectors the codebooks are smaller. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import by_value, persist, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_FURTHEST = 1 << 24
_HOT = 64
_ROWS = 4096


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each value's nearest entry, ties to the lower one, and the squared distance."""
    index, error = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for k in range(0, len(values), _ROWS):
        part = values[k : k + _ROWS]
        far = np.zeros((len(part), len(book)), np.int64)
        for d in range(book.shape[1]):
            gap = part[:, d, None] - book[None, :, d]
            far += gap * gap
        at = far.argmin(1)
        index[k : k + _ROWS], error[k : k + _ROWS] = at, far[np.arange(len(part)), at]
    return index, error


def _assign(books: np.ndarray):
    def assign(batches):
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            values = batch.column("part").flatten().to_numpy().astype(np.int64).reshape(len(pos), -1)
            index, error = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
            for p in np.unique(pos):
                of = pos == p
                index[of], error[of] = nearest(values[of], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int32()), pa.array(error)], names=[*batch.schema.names, "entry", "part_error"])

    return assign


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``at, vec_id, label, q``: a written table of the kept vectors as integers; ``at`` numbers its rows."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    kept = vectors.select("vec_id", "label", x.alias("x")).filter(F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    q = F.transform("x", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(_FURTHEST))), F.lit(float(_FURTHEST)))).cast("int"))
    return persist(kept.select(F.monotonically_increasing_id().alias("at"), "vec_id", "label", q.alias("q")), "integers")


def _parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    padded = F.concat("q", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("q")))
    return kept.select("at", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(padded, p * width + 1, width))).alias("pos", "part"))


def _meet(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with what ``found`` (one row a key, with its ``weight`` in rows) says of their keys."""
    hot = found.filter(F.col("weight") * _HOT >= total)
    cold = found.filter(F.col("weight") * _HOT < total)

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[c for c in right.columns if c not in keys and c != "weight" and how == "inner"])
        on = [left[k].eqNullSafe(right[f"{k}_of"]) for k in keys]
        return left.join(right, on, how).drop(*[f"{k}_of" for k in keys])

    return join(rows, F.broadcast(hot), "inner").unionByName(join(join(rows, F.broadcast(hot), "left_anti"), cold, "inner"))


def fit(kept: DataFrame, distinct: DataFrame, parts: int, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, ``parts x entries x width``: the first kept ids' parts, moved by weighted Lloyd rounds."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = np.array([r.q + [0] * (parts * width - len(r.q)) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        named = distinct.mapInArrow(_assign(books), "pos int, part array<int>, weight long, entry int, part_error long")
        sums = named.groupBy("pos", "entry").agg(F.sum("weight"), *[F.sum(F.col("part")[d] * F.col("weight")) for d in range(width)])
        for pos, entry, n, *total in sums.collect():  # at most parts * entries rows
            books[pos, entry] = [t // n for t in total]
    return books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error, label_error`` for ``vec_id, embedding, label``, and the codebooks.

    ``codes`` holds each part's entry; ``error`` is the squared distance to the entries, ``label_error`` its sum over equal labels."""
    kept = integers(vectors, scale)
    total, longest = kept.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, -(-(longest or 0) // parts))
    rows = _parts(kept, parts, width)
    distinct = persist(rows.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    books = fit(kept, distinct, parts, width, entries, rounds)
    named = distinct.mapInArrow(_assign(books), "pos int, part array<int>, weight long, entry int, part_error long")
    met = _meet(rows, named, ["pos", "part"], total)
    codes = met.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("by_part"), F.sum("part_error").alias("error"))
    codes = codes.select("at", F.transform("by_part", lambda s: s["entry"]).alias("codes"), "error")
    scored = persist(kept.select("at", "vec_id", "label").join(codes, "at").drop("at"), "coded")
    by_label = scored.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight"))
    return _meet(scored, by_label, ["label"], total).select("vec_id", "label", "codes", "error", "label_error"), books


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    sha = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to codebook ``k - 1`` and the codebook after it."""
    return f"""
    a{k} AS ({_nearest(f"b{k - 1}")}),
    m{k} AS (SELECT p, e, list(mean ORDER BY i) AS c FROM (
        SELECT p, e, i, CAST(floor(sum(n * v[i]) / sum(n)) AS BIGINT) AS mean FROM a{k}, unnest(generate_series(1, len(v))) AS g(i) GROUP BY p, e, i) GROUP BY p, e),
    b{k} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e),"""


def _nearest(book: str) -> str:
    gap = "(z[1] - z[2]) * (z[1] - z[2])"
    return f"""SELECT p, v, n, e, far FROM (SELECT d.p, v, n, e, far, row_number() OVER (PARTITION BY d.p, v ORDER BY far, e) AS k
        FROM d JOIN {book} b ON d.p = b.p, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v, c), lambda z: {gap})) AS BIGINT) AS far)) WHERE k = 1"""


SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, label, p, list_slice(q, p * (len(q) // 16) + 1, (p + 1) * (len(q) // 16)) AS v FROM kept, unnest(generate_series(0, 15)) AS g(p)),
    d AS (SELECT p, v, count(*) AS n FROM parts GROUP BY p, v),
    b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
    {_round(1)}{_round(2)}
    a3 AS ({_nearest("b2")}),
    coded AS (SELECT vec_id, label, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' ORDER BY parts.p) AS code, CAST(sum(far) AS BIGINT) AS error
        FROM parts JOIN a3 ON parts.p = a3.p AND parts.v = a3.v GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded"""

by_value(__name__)
