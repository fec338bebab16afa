"""Substring dedup (operator 2): Rabin-Karp hashes of every window of ``width`` words.

Plan. Texts are dealt into groups of about 6 MB by a hash of id and text; rows that are repeated until they fill a group
are written first and dealt by their place. In each group
every window's 64-bit rolling hash is computed with numpy and dealt into ``bucket`` by bits of a
second, independent rolling hash; a group sends one packed array a bucket. A bucket counts its
hashes over the whole corpus and answers each group with the positions of the repeated ones in
the array that came from there. The groups' texts meet the answers in a cogroup, repeated windows
merge into maximal intervals, and those are cut out.

No key can be hot: a passage shared by a third of all documents is at most one array entry a
window, spread like all others, and a group or bucket has the same size whatever the corpus
repeats. Buckets grow with the corpus; a group sends
rows only to buckets that it has windows of, so there are never more than windows. Their bits add to the hash's 64 (``2**-(64 + log2
buckets)`` for a chance match), so accuracy holds at any size.

Defined results: null, empty and short texts (fewer than ``width`` words) keep all their words;
repeated rows are separate documents whose windows repeat each other; a very long text is a group of its own; extra columns are ignored;
an empty table gives an empty result. A null ``doc_id`` is carried through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import by_value, persist, table

WIDTH, GROUP = 35, 6 << 20
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
_MOST_KNOWN = 400_000


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)[:n]


def word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """XXH64 of each word; ``known`` remembers them and is emptied when it grows large."""
    if len(known) > _MOST_KNOWN:
        known.clear()
    code = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = code(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``width`` codes, modulo 2**64: prefix sums of
    code * base**i, differenced, then divided by base**start."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.cumsum(codes * _powers(base, n), dtype=np.uint64)
        spans = sums[width - 1 :].copy()
        spans[1:] -= sums[: n - width]
        return spans * _powers(_inverse(base), n - width + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _windows(texts: list, width: int, buckets: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; each text's number of windows; all windows' hashes and buckets."""
    known: dict[bytes, int] = {}
    split = [t.encode().split() if t else [] for t in texts]
    hashes, buckets_of, counts = [], [], np.zeros(len(split), np.int64)
    for k, words in enumerate(split):
        if len(words) >= width:
            codes = word_codes(words, known)
            hashes.append(rolling(codes, width, _BASES[0]))
            buckets_of.append((_mixed(rolling(codes, width, _BASES[1])) >> np.uint64(33)) % np.uint64(buckets))
            counts[k] = len(hashes[-1])
    none = np.empty(0, np.uint64)
    return split, counts, np.concatenate([none, *hashes]), np.concatenate([none, *buckets_of]).astype(np.int64)


def _by_bucket(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows ordered by bucket; the buckets that have any, and where each begins."""
    by = np.argsort(of, kind="stable")
    full, begin = np.unique(of[by], return_index=True)
    return by, full, np.append(begin, len(by))


def _ask(width: int, buckets: int):
    def ask(group: tuple, rows: pa.Table) -> pa.Table:
        order = rows.column("at").to_numpy().argsort(kind="stable")
        _, _, hashes, of = _windows(rows.column("text").take(order).to_pylist(), width, buckets)
        by, full, cut = _by_bucket(of)
        hashes = hashes[by]
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "g": pa.array([group[0].as_py()] * len(full), pa.int32()),
                "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            }
        )

    return ask


def _count(bucket: tuple, rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]
    again = np.zeros(len(every), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    gs, answers, start = [], [], 0
    for g, x in zip(rows.column("g").to_pylist(), parts, strict=True):
        if (at := np.flatnonzero(again[start : start + len(x)])).size:
            gs.append(g)
            answers.append(at.astype(np.uint32).tobytes())
        start += len(x)
    return pa.table({"g": pa.array(gs, pa.int32()), "bucket": pa.array([bucket[0].as_py()] * len(gs), pa.int32()), "positions": pa.array(answers, pa.binary())})


def _cut(width: int, buckets: int, keep_text: bool):
    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        order = rows.column("at").to_numpy().argsort(kind="stable")
        rows = rows.take(order)
        split, counts, _, of = _windows(rows.column("text").to_pylist(), width, buckets)
        by, full, begin = _by_bucket(of)
        again = np.zeros(len(of), bool)
        held = np.searchsorted(full, answers.column("bucket").to_numpy())
        for k, at in zip(held, answers.column("positions").to_pylist(), strict=True):
            again[by[begin[k] + np.frombuffer(at, np.uint32)]] = True
        ends = np.cumsum(counts)
        removed, shas, texts, spans = [], [], [], []
        for k, words in enumerate(split):
            kept, cuts = words, []
            hits = np.flatnonzero(again[ends[k] - counts[k] : ends[k]])
            if hits.size:  # windows that touch or overlap merge
                gap = np.flatnonzero(np.diff(hits) > width)
                first, last = hits[np.r_[0, gap + 1]], hits[np.r_[gap, -1]] + width
                cuts = list(zip(first.tolist(), last.tolist(), strict=True))
                kept, at = [], 0
                for a, b in cuts:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            joined = b" ".join(kept)
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(joined).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in cuts])
            texts.append(joined.decode() if keep_text else None)
        return pa.table(
            {
                "doc_id": rows.column("doc_id").cast(pa.int64()),
                "n_words": pa.array([len(w) for w in split], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(shas, pa.string()),
                "removed_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(texts, pa.string()),
            }
        )

    return cut


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_removed, kept_sha256, removed_spans, kept_text``.

    ``removed_spans`` are maximal word intervals (end exclusive). ``keep_text=False`` leaves
    ``kept_text`` null."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("at"))
    total, most = rows.groupBy("at").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("times")).agg(F.sum("n"), F.max(F.when(F.col("times") > 1, F.col("n")))).first()
    groups = buckets = max(16, -(-(total or 0) // GROUP))
    if (most or 0) > GROUP:  # rows repeated by the thousand: they are told apart by their place in a written table
        rows = persist(rows, "repeated").withColumn("at", F.monotonically_increasing_id()).withColumn("at", F.xxhash64("at"))
    dealt = rows.withColumn("g", F.pmod("at", F.lit(groups)).cast("int")).repartition(int(groups), "g")
    asked = dealt.groupBy("g").applyInArrow(_ask(width, int(buckets)), "bucket int, g int, hashes binary")
    answers = asked.groupBy("bucket").applyInArrow(_count, "g int, bucket int, positions binary")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        _cut(width, int(buckets), keep_text),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<start:long,end:long>>, kept_text string",
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


by_value(__name__)
