"""Benchmark decontamination (operator 3): SimHash of item-sized windows, found by multi-index
Hamming blocks and verified by exact weighted-shingle similarity.

1. Texts are lower-cased (A-Z), split into words and hashed in shingles of five words. Windows as
   long as a benchmark item (cut off at the text's ends) are taken wherever they can reach the
   similarity: that takes enough shingles of one item, at whatever offset, so each item's shingles
   are counted in a window that slides over the text, and every start with enough is fingerprinted.
2. A window's 64-bit SimHash is cut into five blocks of 13 or 12 bits. Fingerprints within ``RADIUS`` = 19
   bits differ in at most three bits of some block, and the index holds each item's blocks with all
   variants of up to three bits: every item within the radius is found, and one in five others.
3. Fingerprints within the radius are verified: weighted Jaccard similarity (sum of minima over sum
   of maxima of the shingles' counts) of window and item at ``SIMILARITY`` or more.

At the similarity 0.8 the expected distance is below 10 bits with a deviation of 3, so the radius
takes in all but about one in a thousand of the windows that have no more than that.

Only built-in functions run. Texts are scanned twice: shingles are exploded from zipped slices of the words (compiled
code, no function a word) into a broadcast join (benchmark's shingles, up to ``MOST_SHINGLES``; a shuffled join beyond),
and places of the matching ones are gathered by text and item; texts with starts (broadcast up to ``MOST_LEAKS`` texts)
are then cut into their windows. The index (some 1,800 rows an item) is
broadcast behind a count of its own rows (``MOST_INDEX``), else met by a shuffle.

Defined results: null and wordless texts and items match nothing; an item of fewer than five words
is one shingle of its own length; texts shorter than an item are compared as a whole; repeated rows
give one pair; a null ``doc_id`` is reported as null; of equally similar windows the first is
reported; a very long text costs its words once, and windows only where items may be; extra columns are
ignored by ``leaks`` and kept by ``remove_leaks``, whatever their names; an empty table on either side gives no leaks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded, free_name, let, lower_az, persist, table, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS = (13, 13, 13, 13, 12)  # bits
MOST_SHINGLES, MOST_INDEX, MOST_LEAKS = 1_000_000, 100_000, 200_000
_FLIPS = RADIUS // len(BLOCKS)  # bits that some block of fingerprints within the radius differs in at most


def _shingles(w: Column, width: int) -> Column:
    """Hash of each ``width`` consecutive words; of none if there are fewer."""
    starts = F.sequence(F.lit(0), F.size(w) - width)
    hashed = F.transform(starts, lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(width)]))
    return F.when(F.size(w) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def _by_width(width: Column, w: Column) -> Column:
    found = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        found = F.when(width == k, _shingles(w, k)).otherwise(found)
    return found


def _rows(split: DataFrame, width: int) -> DataFrame:
    """Each text's shingles (``gram``) with their places (``p``), one a row."""
    n = F.greatest(F.size("w") - (width - 1), F.lit(0))
    places = split.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(*[F.slice("w", F.lit(k + 1), n).alias(f"w{k}") for k in range(width)])).alias("p", "z"))
    return places.select("doc_id", "text_hash", "p", F.xxhash64(*[F.col(f"z.w{k}") for k in range(width)]).alias("gram"))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _simhash(h: Column) -> Column:
    """Bits set in more than half of the hashes. Ones are counted in lanes of a few longs, which an addition
    moves all at once; a lane's highest bit stays clear, so the number of hashes decides its width."""

    def in_lanes(bits: int) -> Column:
        mask = sum(1 << b for b in range(0, 64, bits))
        zero = F.struct(*[_long(0).alias(f"l{j}") for j in range(bits)])
        add = lambda acc, x: F.struct(*[(acc[f"l{j}"] + F.shiftrightunsigned(x, j).bitwiseAND(_long(mask))).alias(f"l{j}") for j in range(bits)])
        ones = lambda acc, b: F.shiftrightunsigned(acc[f"l{b % bits}"], b - b % bits).bitwiseAND(_long((1 << bits) - 1))
        top = lambda b: _long((1 << b) if b < 63 else -(1 << 63))

        def whole(acc: Column) -> Column:
            fp = _long(0)
            for b in range(64):
                fp = fp.bitwiseOR(F.when(2 * ones(acc, b) > F.size(h), top(b)).otherwise(_long(0)))
            return fp

        return F.aggregate(h, zero, add, whole)

    ones = lambda b: F.size(F.filter(h, lambda x: F.call_function("shiftright", x, b).bitwiseAND(_long(1)) == 1))
    bit = lambda b: F.when(2 * ones(b) > F.size(h), F.call_function("shiftleft", _long(1), b)).otherwise(_long(0))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), _long(0), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(h) < 1 << 7, in_lanes(8)).when(F.size(h) < 1 << 15, in_lanes(16)).otherwise(many)


def _numbered(h: Column) -> Column:
    """The multiset as a set: each shingle hashed with its number among its equals."""
    return let(F.sort_array(h), lambda s: F.transform(s, lambda x, k: F.xxhash64(x, k - F.array_position(s, x).cast("int"))))


def _block(fp: Column, j: int) -> Column:
    return F.shiftrightunsigned(fp, sum(BLOCKS[:j])).bitwiseAND(_long((1 << BLOCKS[j]) - 1)).cast("int")


def _index(items: DataFrame) -> DataFrame:
    """``item_id, n, item_fp, block, code``: each block of each item with every flip of up to ``_FLIPS`` bits."""

    def codes(j: int, bits: int) -> Column:
        flips = [sum(1 << b for b in at) for n in range(_FLIPS + 1) for at in combinations(range(bits), n)]
        return F.transform(F.array(*[F.lit(x) for x in flips]), lambda f: F.struct(F.lit(j).alias("block"), _block(F.col("fp"), j).bitwiseXOR(f).alias("code")))

    every = F.concat(*[codes(j, bits) for j, bits in enumerate(BLOCKS)])
    return items.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(every).alias("x")).select("item_id", "n", "item_fp", "x.*")


def _starts(at: Column, shingles: Column) -> Column:
    """Starts (negative ones cut off) of the windows that hold enough of the item's shingles, found ``at`` these places in order.

    Common shingles are at least ``SIMILARITY`` of the item's, or the similarity isn't reached: each run of so many places
    within a window's reach gives the starts that hold it."""
    least = F.ceil(shingles * F.lit(SIMILARITY) - 1e-9).cast("int")
    last = lambda i: F.get(at, i + least - 1)
    runs = F.filter(F.transform(at, lambda p, i: F.struct(p.alias("first"), last(i).alias("last"))), lambda r: r["last"] - r["first"] < shingles)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["last"] - shingles + 1, r["first"]))))


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select("item_id", words(lower_az(F.col("text"))).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), "w").distinct()
    rows = rows.select("item_id", "n", "width", let(_by_width(F.col("width"), F.col("w")), lambda h: F.struct(h.alias("h"), _simhash(h).alias("fp"), _numbered(h).alias("numbered"))).alias("x"))
    return persist(rows.select("item_id", "n", "width", "x.*"), "items")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, similarity, start_word``: the best window of each pair."""
    items = _items(benchmark)
    grams = persist(items.select("item_id", "n", "width", F.explode("h").alias("gram")).distinct(), "grams")
    hint = F.broadcast if bounded(grams, MOST_SHINGLES) else (lambda df: df)
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most SHINGLE rows

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    split = texts.select("doc_id", "text_hash", words(lower_az(F.col("text"))).alias("w"))
    found = None
    for width in widths:
        met = _rows(split, width).join(hint(grams.where(F.col("width") == width)), "gram").groupBy("doc_id", "text_hash", "width", "n", "item_id").agg(F.sort_array(F.collect_set("p")).alias("at"))
        met = met.select("doc_id", "text_hash", "width", "n", F.explode(let(F.col("at"), lambda at: _starts(at, F.col("n") - width + 1))).alias("start"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return split.limit(0).selectExpr("doc_id", "text_hash", "cast(null as bigint) as item_id", "cast(null as double) as similarity", "cast(null as int) as start_word")
    found = found.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("width", "n", "start")).alias("found"))
    found = persist(found.withColumnsRenamed({"doc_id": "leak_id", "text_hash": "leak_hash"}), "starts")
    near = F.broadcast(found) if bounded(found, MOST_LEAKS) else found
    windows = texts.join(near, texts["doc_id"].eqNullSafe(near["leak_id"]) & (texts["text_hash"] == near["leak_hash"])).dropDuplicates(["doc_id", "text_hash"])
    cut = lambda w, x: F.slice(w, F.greatest(x["start"], F.lit(0)) + 1, x["start"] + x["n"] - F.greatest(x["start"], F.lit(0)))
    each = let(words(lower_az(F.col("text"))), lambda w: F.transform("found", lambda x: F.struct(x["width"].alias("width"), x["n"].alias("n"), x["start"].alias("start"), cut(w, x).alias("window"))))
    windows = windows.select("doc_id", "text_hash", F.explode(each).alias("x")).select("doc_id", "text_hash", "x.*")
    windows = windows.select("*", let(_by_width(F.col("width"), F.col("window")), lambda h: F.struct(_simhash(h).alias("fp"), h.alias("h"))).alias("x"))
    windows = persist(windows.select("doc_id", "text_hash", "n", "start", "x.*"), "windows")

    index = persist(_index(items), "index")
    index = F.broadcast(index) if bounded(index, MOST_INDEX) else index
    blocks = F.array(*[_block(F.col("fp"), j) for j in range(len(BLOCKS))])
    near = windows.select("*", F.posexplode(blocks).alias("block", "code")).join(index, ["n", "block", "code"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, j)) <= _FLIPS, F.lit(j)) for j in range(len(BLOCKS))])  # each pair once
    near = near.where((F.bit_count(apart) <= RADIUS) & (first == F.col("block"))).select("doc_id", "text_hash", "n", "start", "item_id", _numbered(F.col("h")).alias("numbered"))
    verified = near.join(hint(items.select("item_id", "n", F.col("numbered").alias("item_numbered"))), ["item_id", "n"])
    common = F.size(F.array_intersect("numbered", "item_numbered"))
    verified = verified.withColumn("similarity", common / (F.size("numbered") + F.size("item_numbered") - common)).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    return verified.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.similarity", F.greatest(-F.col("best.before"), F.lit(0)).alias("start_word"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no leak."""
    own_id, own_hash = free_name(docs, "own_id"), free_name(docs, "own_hash")
    found = persist(leaks(docs, benchmark).select(F.col("doc_id").alias("leak id"), F.col("text_hash").alias("leak hash")).distinct(), "leaks")
    found = F.broadcast(found) if bounded(found, MOST_LEAKS) else found
    named = docs.withColumns({own_id: F.col("doc_id"), own_hash: F.xxhash64("text")})
    return named.join(found, named[own_id].eqNullSafe(found["leak id"]) & (named[own_hash] == found["leak hash"]), "left_anti").select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
item_grams AS (
  SELECT item_id, len(w) AS n, o - 1 AS o, array_to_string(w[o:o + 4], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS o FROM items)),
doc_grams AS (
  SELECT doc_id, p - 1 AS p, array_to_string(w[p:p + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM docs)),
starts AS (SELECT DISTINCT doc_id, n, unnest(range(p - n + 5, p + 1)) AS start FROM (SELECT DISTINCT doc_id, n, p FROM doc_grams JOIN item_grams USING (gram))),
window_grams AS (
  SELECT s.doc_id, s.n, s.start, gram, count(*) AS c, any_value(size) AS size
  FROM (SELECT s.doc_id, s.n, s.start, g.gram, count(*) OVER (PARTITION BY s.doc_id, s.n, s.start) AS size
        FROM starts s JOIN doc_grams g ON g.doc_id = s.doc_id AND g.p >= s.start AND g.p + 5 <= s.start + s.n) s
  GROUP BY ALL),
item_counts AS (
  SELECT item_id, n, gram, count(*) AS c, any_value(size) AS size
  FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS size FROM item_grams) GROUP BY item_id, n, gram),
pairs AS (
  SELECT doc_id, start, item_id, sum(least(a.c, b.c)) AS common, any_value(a.size) + any_value(b.size) AS together
  FROM window_grams a JOIN item_counts b USING (n, gram) GROUP BY doc_id, start, item_id),
scored AS (SELECT *, (common / (together - common))::DOUBLE AS similarity FROM pairs)
SELECT doc_id, item_id, similarity, greatest(start, 0)::INT AS start_word
FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
