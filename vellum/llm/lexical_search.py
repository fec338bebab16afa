"""Ranked lexical search (operator 12): Block-Max WAND over compressed posting blocks.

Plan. One scan counts terms (``N`` documents with any, ``L`` terms). A second scan builds the index where the
texts lie, with no shuffle of texts: every 32 MB of a scan task's texts become a *shard*, whose documents are
numbered by id. A shard's row for a term holds its postings in blocks of 128: gaps of document numbers and
counts, each in as many bytes as the block needs, and beside them, readable without decompression, every
block's last document and its largest impact. The index is written; items' terms get their document
frequencies from it. Each block of items (at most ``ASK`` bytes of terms) is then sent to all shards: a shard
gathers its rows of these terms and answers with its ``k`` best documents an item, which a window merges.

In a shard, the ends of all blocks of an item's terms cut the documents into ranges; inside a range no
pointer leaves its block. Pointers first move shallowly, by the blocks' last documents alone, and sum the
blocks' largest impacts to a bound of every range. Ranges are opened from the highest bound down, and only
their blocks are decompressed; the k-th best score so far is the threshold, and ranges bounded below it
are skipped with all blocks that no live range needs. A range at the threshold is opened, for ties.

Skew. A shard is bounded whatever the texts repeat, and a frequent term is one row a shard. Items' terms of a
block are broadcast; their bytes are bounded by the cut into blocks.

Defined results: null and empty texts have no terms and are never ranked; an item without terms, or with
terms of no document, has no rows. Rows of one ``item_id`` are one item of all their terms, null ids
too. Repeated documents are ranked each; equal scores go by ascending id, null ids last. Very long texts are
shards of their own size. Extra columns are ignored. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import by_value, free, lower_az, persist, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, BLOCK, SHARD, ASK = 10, 128, 32 << 20, 4 << 20
#: Bytes of UTF-8 as terms have them: A-Z lowered, all that no term holds made a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "shard long, term binary, df int, last binary, peak binary, widths binary, gaps binary, counts binary"
_ROWS = 20_000
_ODD = 1 << 50  # lengths' m from here on make an impact of 0 at any count of this size


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class _Numbers(dict):
    """Terms by number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a row, from bytes that lie row after row."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def compress(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of blocks in 1, 2 or 4 bytes each: bytes, each block's width, and where each value ends."""
    sizes = np.diff(np.append(starts, len(values)))
    most = np.maximum.reduceat(values, starts)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    ends = np.cumsum(np.repeat(widths, sizes))
    at = ends - np.repeat(widths, sizes)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(4):
        wide = np.repeat(widths, sizes) > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255
    return out, widths, ends


def decompress(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}", n, at).astype(np.int64)


class _Shard:
    """The documents of a shard while it is built."""

    def __init__(self) -> None:
        self.ids, self.ms, self.sizes, self.bytes = [], [], [], 0
        self.numbers, self.terms, self.counts = _Numbers(), [], []

    def add(self, doc_id: int | None, text: bytes, ratio: tuple[int, int]) -> None:
        words = text.translate(_BYTES).split()
        if words:
            n, total = ratio
            found = Counter(words)
            self.ids.append(doc_id)
            self.ms.append(min(_ODD, 25 + 75 * len(words) * n // total))
            self.sizes.append(len(found))
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
            self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
            self.bytes += len(text)

    def rows(self, shard: int):
        """Index rows: first the directory (no term; ids, which of them are null, m), then one a term."""
        if not self.ids:
            return
        by_id = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        number = np.empty(len(by_id), np.int64)
        number[by_id] = np.arange(len(by_id))
        m = np.array(self.ms, np.int64)[by_id]
        ids = np.array([self.ids[k] or 0 for k in by_id], "<i8")
        nulls = np.array([self.ids[k] is None for k in by_id], np.uint8)
        yield _batch([shard], [None], [len(by_id)], [ids.tobytes()], [nulls.tobytes()], [b""], [m.tobytes()], [b""])
        term, count, doc = np.concatenate(self.terms), np.concatenate(self.counts), np.repeat(number, self.sizes)
        order = np.lexsort((doc, term))
        term, count, doc = term[order], count[order], doc[order]
        df = np.bincount(term)
        first = np.cumsum(df) - df
        place = np.arange(len(term)) - np.repeat(first, df)
        starts = np.flatnonzero(place % BLOCK == 0)
        last_at = np.append(starts[1:], len(term)) - 1
        gaps = np.where(place == 0, doc, doc - np.concatenate([[0], doc[:-1]]))
        packed_gaps, gap_widths, gap_ends = compress(gaps, starts)
        packed_counts, count_widths, count_ends = compress(count, starts)
        blocks = np.cumsum(-(-df // BLOCK))
        ends = np.cumsum(df) - 1
        last, peak = doc[last_at].astype("<u4"), np.maximum.reduceat(impact(count, m[doc]), starts).astype("<u4")
        columns = [
            pa.array(np.full(len(df), shard)), pa.array(list(self.numbers), pa.binary()), pa.array(df, pa.int32()), _slices(last.view(np.uint8), blocks * 4), _slices(peak.view(np.uint8), blocks * 4),
            _slices((gap_widths * 16 + count_widths).astype(np.uint8), blocks), _slices(packed_gaps, gap_ends[ends]), _slices(packed_counts, count_ends[ends]),
        ]
        for k in range(0, len(df), _ROWS):
            yield _batch(*[c.slice(k, _ROWS) for c in columns])


def _batch(*columns) -> pa.RecordBatch:
    names = [part.split()[0] for part in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _build(n: int, total: int, most: int):
    def build(batches):
        task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard.add(doc_id, (text or "").encode(), (n, total))
                if shard.bytes >= most:
                    yield from shard.rows((task << 24) + made)
                    made, shard = made + 1, _Shard()
        yield from shard.rows((task << 24) + made)

    return build


class _Postings:
    """A term's postings in one shard. Blocks are decompressed when first asked for."""

    def __init__(self, df: int, last: bytes, peak: bytes, widths: bytes, gaps: bytes, counts: bytes, m: np.ndarray) -> None:
        self.last, self.peak = np.frombuffer(last, "<u4").astype(np.int64), np.frombuffer(peak, "<u4").astype(np.int64)
        widths = np.frombuffer(widths, np.uint8)
        sizes = np.full(len(widths), BLOCK)
        sizes[-1] = df - BLOCK * (len(widths) - 1)
        self.sizes, self.gap_widths, self.count_widths = sizes, widths >> 4, widths & 15
        self.gaps_at, self.counts_at = (np.cumsum(sizes * w) - sizes * w for w in (self.gap_widths, self.count_widths))
        self.gaps, self.counts, self.m = gaps, counts, m
        self.open = [None] * len(widths)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        if self.open[b] is None:
            n = int(self.sizes[b])
            docs = np.cumsum(decompress(self.gaps, int(self.gaps_at[b]), n, int(self.gap_widths[b]))) + (self.last[b - 1] if b else 0)
            self.open[b] = docs, impact(decompress(self.counts, int(self.counts_at[b]), n, int(self.count_widths[b])), self.m[docs])
        return self.open[b]


def best(asked: list[tuple[int, _Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``k`` best documents for terms with these gains, best first."""
    ends = np.unique(np.concatenate([p.last for _, p in asked]))  # ranges end where any block does
    held = [np.searchsorted(p.last, ends) for _, p in asked]  # the block that each range lies in, or none
    bound = np.zeros(len(ends), np.int64)
    for (gain, p), at in zip(asked, held, strict=True):
        bound += gain * np.append(p.peak, 0)[at]
    order = np.argsort(-bound, kind="stable")
    scores = np.zeros(n_docs, np.int64)
    found, threshold, begin, step = np.empty(0, np.int64), 1, 0, 16
    while begin < len(order) and bound[order[begin]] >= threshold:
        ranges = order[begin : begin + step]
        ranges = ranges[bound[ranges] >= threshold]
        begin, step = begin + step, step * 4
        live = np.zeros(len(ends), bool)
        live[ranges] = True
        touched = []
        for (gain, p), at in zip(asked, held, strict=True):
            blocks = np.unique(at[ranges])
            opened = [p.block(b) for b in blocks.tolist() if b < len(p.last)]
            if opened:
                docs, impacts = (np.concatenate(x) for x in zip(*opened, strict=True))
                inside = live[np.searchsorted(ends, docs)]
                docs = docs[inside]
                scores[docs] += gain * impacts[inside]
                touched.append(docs)
        found = np.unique(np.concatenate([found, *touched]))
        found = found[np.lexsort((found, -scores[found]))][:k]
        found = found[scores[found] > 0]
        if len(found) == k:
            threshold = int(scores[found[-1]])
    return found, scores[found]


def _search(items: dict, k: int):
    def search(rows: pa.Table) -> pa.Table:
        directory = rows.filter(pa.compute.is_null(rows.column("term")))
        ids = np.frombuffer(directory.column("last")[0].as_py(), "<i8")
        nulls = np.frombuffer(directory.column("peak")[0].as_py(), np.uint8)
        m = np.frombuffer(directory.column("gaps")[0].as_py(), np.int64)
        postings = {term: _Postings(*rest, m) for term, *rest in zip(*[rows.column(c).to_pylist() for c in ("term", "df", "last", "peak", "widths", "gaps", "counts")], strict=True) if term is not None}
        out: tuple[list, list, list] = ([], [], [])
        for item, gains in items.items():
            asked = [(gain, postings[t]) for t, gain in gains if t in postings]
            if asked:
                docs, scores = best(asked, len(ids), k)
                out[0].extend([item] * len(docs))
                out[1].extend(None if nulls[d] else int(ids[d]) for d in docs)
                out[2].extend(scores.tolist())
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("item_id", "doc_id", "score"), out, strict=True)})

    return search


def build_index(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The written index of all documents, and the number of documents with a term."""
    sizes = docs.select(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).alias("n")).filter("n > 0")
    n, total = sizes.agg(F.count("*"), F.sum("n")).first()
    return persist(docs.select("doc_id", "text").mapInArrow(_build(n, total or 1, shard), _INDEX), "postings"), n


def gains(items: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """``item_id, term, gain``: a term's weight as often as the item has it; terms of no document have none."""
    asked = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    df = index.filter("term is not null").select("term", F.col("df").alias("in_shard")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("in_shard").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    return asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("gain")).filter("gain > 0")


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, ask: int = ASK) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    index, n = build_index(docs, shard)
    asked = persist(gains(items, index, n), "gains")
    blocks = 1 + (asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) // ask
    found = []
    for b in range(blocks):  # one block of items at a time is in memory, at the driver and in tasks
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        by_item: dict = {}
        for r in mine.collect():
            by_item.setdefault(r.item_id, []).append((bytes(r.term), r.gain))
        rows = index.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi").unionByName(index.filter("term is null"))
        found.append(persist(rows.groupBy("shard").applyInArrow(_search(by_item, k), "item_id long, doc_id long, score long"), "found"))
    free(index, asked)
    every = spark.read.schema(found[0].schema).parquet(*[f.scratch_path for f in found])
    best_first = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH words AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
    asked AS (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark),
    times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
    scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
        FROM times JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

by_value(__name__)
