"""Sharding (operator 9): contiguous shards of near-equal bytes, from global prefix sums.

Rows are range-partitioned by (text hash, id), so equal texts lie together and one huge group of
copies still spreads over many partitions. Each partition's total is taken once; the totals' own
prefix sums (one row a partition) turn the running sums inside partitions into global ones. Shard k
of n takes the bytes from k/n to (k+1)/n of the total. Where a cut falls into a group of equal
texts and the smaller part is at most ``SNAP`` of a shard, that part joins the rest of its group;
a larger group is split at the cut, as balance then matters more.

Only built-in DataFrame functions run here, and texts are never shuffled: hash, size and checksum go.

Defined results: null text counts 0 bytes (plus ``OVERHEAD``) and hashes like an empty one; repeated
rows are placed separately, ties in (hash, id) in any order; an empty table gives an empty result;
``assign`` ignores extra columns, ``add_shards`` keeps them (its own columns replace clashing ones). A very long
text is one row of its size: shards are balanced to within the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import free_name, persist, table

SHARDS, OVERHEAD, SNAP, ROWS_A_PART = 40, 16, 0.02, 1_000_000


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, snap: float = SNAP) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, text_hash``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
    )
    group = ("text_hash", "text_crc32", "size")
    rows = persist(rows, "sizes")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    parts = max(16, -(-count // ROWS_A_PART))
    dealt = persist(rows.repartitionByRange(parts, *group, "doc_id").withColumn("part", F.spark_partition_id()), "ranges")

    # one row a partition: their number is fixed above, whatever the rows
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy(*group, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(offsets), "part").select(
        "doc_id", *group,
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("from_byte"),
        (F.col("rows_before") + F.count("*").over(inside)).alias("row_no"),
    )
    placed = persist(placed, "placed")

    def nominal(byte):
        return F.floor(byte.cast("decimal(20,1)") * shards / total).cast("long")

    # groups that a cut falls into: at most one a cut
    held = placed.groupBy(*group).agg(F.min("from_byte").alias("group_from"), F.max(F.col("from_byte") + F.col("size")).alias("group_to"))
    held = held.withColumn("first", nominal(F.col("group_from"))).withColumn("last", nominal(F.col("group_to") - 1)).where("first < last")

    slack = F.lit(total * snap / shards)
    own = nominal(F.col("from_byte") + F.col("size") / 2)
    start_part = (F.col("first") + 1) * total / shards - F.col("group_from")
    end_part = F.col("group_to") - F.col("last") * total / shards
    low = F.when(start_part <= slack, F.col("first") + 1).otherwise(F.col("first"))
    high = F.when(end_part <= slack, F.col("last") - 1).otherwise(F.col("last"))
    snapped = F.greatest(F.least(own, F.greatest(low, high)), low)
    sharded = placed.join(F.broadcast(held), list(group), "left")
    sharded = sharded.withColumn("shard", F.least(F.when(F.col("first").isNull(), own).otherwise(snapped), F.lit(shards - 1)).cast("int"))
    starts = sharded.groupBy("shard").agg(F.min("row_no").alias("shard_from"))  # at most `shards` rows
    out = sharded.join(F.broadcast(starts), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("shard_from")).alias("slot"), "text_hash")


def add_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``text_crc32`` and ``shard`` (columns of these names are replaced, all
    others kept). Shards are contiguous in (text hash, checksum, size, id), so ``assign``'s are given back by
    their first keys, at most one a shard, as literals: no text is moved. Rows equal in all of the key that a
    cut falls between are dealt to their shards by row position, in the proportion that ``assign`` found."""
    placed = assign(docs, shards)
    key = F.struct("text_hash", "text_crc32", "size", "doc_id")
    placed = persist(placed.groupBy("shard").agg(F.min(key).alias("k")), "first-keys"), placed
    firsts = sorted(placed[0].collect(), key=lambda r: r.shard)  # at most `shards` rows
    new = ["size", "text_crc32", "shard"]
    text, position = F.coalesce("text", F.lit("")), free_name(docs, "own_key")
    rows = docs.drop(*new).withColumns({"size": (F.octet_length(text) + OVERHEAD).cast("long"), "text_crc32": F.crc32(text)})
    if not firsts:
        return rows.withColumn("shard", F.lit(None).cast("int")).select(*docs.drop(*new).columns, *new)
    rows = rows.withColumn(position, F.struct(F.xxhash64(text).alias("text_hash"), "text_crc32", "size", F.col("doc_id").cast("long").alias("doc_id")))
    literal = lambda k: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(k.__fields__, k, strict=True)])
    shard = F.coalesce(*[F.when(F.col(position) >= literal(r.k), F.lit(r.shard)) for r in reversed(firsts)])
    # keys on both sides of a cut: those of a first row that also end the shard before
    on_cut = placed[1].select("shard", key.alias("k")).where(F.col("k").isin(*[literal(r.k) for r in firsts]))
    spread: dict = {}
    for r in sorted(on_cut.groupBy("k", "shard").count().collect(), key=lambda r: r.shard):  # at most two a cut
        spread.setdefault(tuple(r.k), []).append((r.k, r.shard, r["count"]))
    draw = free_name(rows, "own_draw")
    if any(len(held) > 1 for held in spread.values()):
        rows = rows.withColumn(draw, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30))
    for held in spread.values():
        if len(held) > 1:
            total, upto, dealt = sum(n for _, _, n in held), 0, None
            for _, s, n in held:
                upto += n
                test = F.col(draw) < upto / total
                dealt = F.when(test, F.lit(s)) if dealt is None else dealt.when(test, F.lit(s))
            shard = F.when(F.col(position) == literal(held[0][0]), dealt.otherwise(F.lit(held[-1][1]))).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int")).select(*docs.drop(*new).columns, *new)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
