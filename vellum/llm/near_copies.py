"""Near copies at a similarity (operator 7 as a filter): one document of each group stays.

Two texts link if the sets of their shingles (``WIDTH`` words, A-Z lower-cased) have a Jaccard
similarity of at least ``SIMILARITY``; groups are the connected components. Candidates come from

1. the fingerprints' vantage-point trees (``simhash_dedup.links``), and
2. min-hash bands: ``BANDS`` keys of ``ROWS`` minima each. At 0.8 SimHash pairs lie up to a quarter of
   all bits apart, a radius at which no vantage point prunes; a pair at 0.8 shares a band but for
   6 cases in 100,000, one at 0.85 but for 4 in 10 million.

Every candidate is verified on the whole sets, in integers, so no unlike pair links.

Equal sets are one node, so exact copies never meet in one task. Members of a band are never compared
all with all. In each round a band draws one leader by hash, every member of another component
meets it, and components are joined, so a big group of copies costs one comparison a member and round;
rounds end when they link few (``YIELD``).
Bands that still hold several components then give up their nodes to an exact prefix join: with the
shingles of a set ordered from rare to frequent, two sets at the similarity share a shingle among the
first ``size - ceil(similarity * size) + 1`` of both, at places that leave enough overlap. Frequent
passages sort last and leave the prefix unless a text is nearly made of them. Any common order
is right, so frequencies are counted by ``BUCKETS`` hash buckets, a bounded table.

Defined results: null and wordless texts have the empty set and are copies of each other; texts of fewer
words than a shingle are one shingle; of a group the smallest ``doc_id`` stays (a null one only if all
are null); repeated rows leave one; a very long text's set is made whole; extra columns are kept, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import simhash_dedup
from vellum.llm.common import LOWER, UPPER, bounded, by_value, free, free_name, persist, persist_batched
from vellum.llm.components import connected_components
from vellum.llm.substring_dedup import rolling, word_codes

WIDTH, SIMILARITY = 5, (4, 5)  # the similarity as a fraction
BANDS, ROWS = 32, 6
MOST_WANTED = 200_000  # rows of a pair of ids and hashes in a broadcast
SALTS = 8  # pieces of a band when its leader is joined to its members by shuffle
ROUNDS, YIELD, BUCKET_BITS = 8, 4, 17
BUCKETS = 1 << BUCKET_BITS
_KNOWN = 100_000  # words remembered between batches, so that idle workers keep little
_BASE, _CHUNK = 0xD6E8FEB86659FD93, 1024
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FACTORS = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    width = min(WIDTH, len(words))
    with np.errstate(over="ignore"):
        x = rolling(word_codes(words, known), width, _BASE)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        return np.unique(x ^ (x >> np.uint64(28)))


def band_keys(grams: np.ndarray) -> list[int]:
    """One key a band; none for the empty set."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), _CHUNK):
            np.minimum(least, (grams[None, at : at + _CHUNK] * _FACTORS[0] + _FACTORS[1]).min(1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _node(grams: np.ndarray) -> tuple[int, int, list[int]]:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63), len(grams), band_keys(grams)


def _described(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        if len(known) > _KNOWN:
            known.clear()
        found = [_node(shingle_set(t, known)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(np.fromiter(map(simhash_dedup.fingerprint, texts), np.uint64, len(texts)).view(np.int64)),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_hash", "fp", "node", "size", "keys"],
        )


def _sets(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        if len(known) > _KNOWN:
            known.clear()
        grams = [shingle_set(t, known).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary())], names=["node", "grams"])


def _verified(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(SIMILARITY[1] * common >= SIMILARITY[0] * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(batches):
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for grams in batch.column("grams"):
            np.add.at(seen, _bucket(np.frombuffer(grams.as_buffer(), np.uint64)), 1)
    held = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["bucket", "n"])


def prefix(grams: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which any set at the similarity has one among its own."""
    n = len(grams)
    least = -(-SIMILARITY[0] * n // SIMILARITY[1])
    return grams[np.lexsort((grams, often[_bucket(grams)]))[: n - least + 1]]


def _prefixes(often: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [prefix(np.frombuffer(g.as_buffer(), np.uint64), often).view(np.int64) for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "size", "root")), pa.array(found, pa.list_(pa.int64()))], names=["node", "size", "root", "tokens"])

    return run


def _allowed(x: str, y: str):
    """Sets of these sizes can have the similarity."""
    return SIMILARITY[1] * F.least(x, y) >= SIMILARITY[0] * F.greatest(x, y)


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it is counted to be small."""
    return F.broadcast(df) if bounded(df, MOST_WANTED) else df


def _verify(pairs: DataFrame, grams: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. Only sets of nodes on a pair move: a's to b, where
    each b's set (one for all members of a leader) arrives once."""
    small = _small(pairs)
    x = grams.join(small.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), "b", F.col("grams").alias("x"))
    wanted = _small(pairs.select(F.col("b").alias("node")).distinct())
    y = grams.join(wanted, "node", "left_semi").select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return persist_batched(x.join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), label)


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes by the vantage-point trees: each with the first of its fingerprint, those with each other."""
    by = persist(nodes.groupBy("fp").agg(F.min("node").alias("first")), "by-fingerprint")
    same = nodes.join(by, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    a, b = (by.select(F.col("fp").alias(x), F.col("first").alias(f"{x}1")) for x in ("a", "b"))
    linked = simhash_dedup.links(by.select("fp")).join(a, "a").join(b, "b").select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    return same.unionByName(linked)


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, size, root`` of the bands that hold more than one component."""
    rooted = members.select("key", "node", "size").join(roots, "node")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    return persist(rooted.join(mixed, "key", "left_semi"), "unsettled")


def _leader_pairs(unsettled: DataFrame, k: int) -> DataFrame:
    """Each member of a band with the band's leader of round ``k``, if that is of another component."""
    leader = F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), "node", "size", "root"))
    leaders = persist(unsettled.groupBy("key").agg(leader.alias("l")), "leaders")
    if bounded(leaders, MOST_WANTED):
        led = unsettled.join(F.broadcast(leaders), "key")
    else:  # a band may hold a third of all nodes, so its members are joined in pieces
        pieces = leaders.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        led = unsettled.withColumn("piece", F.pmod("node", F.lit(SALTS)).cast("int")).join(pieces, ["key", "piece"])
    led = led.where((F.col("root") != F.col("l.root")) & _allowed("size", "l.size"))
    return led.select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b")).distinct()


def _prefix_pairs(unsettled: DataFrame, grams: DataFrame) -> DataFrame:
    """All pairs of these nodes that are of different components and may have the similarity."""
    held = persist_batched(_small(persist(unsettled.select("node", "size", "root").distinct(), "unsettled-nodes")).join(grams, "node"), "unsettled-sets")
    counted = held.select("grams").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    often = np.zeros(BUCKETS, np.int32)
    often[counted["bucket"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), np.iinfo(np.int32).max)
    found = held.mapInArrow(_prefixes(often), "node long, size long, root long, tokens array<long>")
    found = persist_batched(found.select("node", "size", "root", F.posexplode("tokens").alias("at", "token")), "prefixes")
    mixed = found.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    found = found.join(mixed, "token", "left_semi")
    x, y = (found.select("token", *(F.col(c).alias(f"{p}{c}") for c in ("node", "size", "root", "at"))) for p in ("x", "y"))
    s, t = SIMILARITY
    enough = (s + t) * F.least(F.col("xsize") - F.col("xat"), F.col("ysize") - F.col("yat")) >= s * (F.col("xsize") + F.col("ysize"))
    both = x.join(y, "token").where((F.col("xnode") > F.col("ynode")) & (F.col("xroot") != F.col("yroot")) & _allowed("xsize", "ysize") & enough)
    return both.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` with the components joined that these links join; ``roots`` and ``links`` are freed."""
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("a", "b"))
    edges = links.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    found = connected_components(edges)
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    merged = persist(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "node-roots")
    free(roots, links, found)
    return merged


def groups(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: ``doc_id, text_hash, root``; rows of a group share the root."""
    described = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    rows = persist_batched(described.mapInArrow(_described, "doc_id long, text_hash long, fp long, node long, size long, keys array<long>"), "described")
    nodes = rows.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id", "fp")).alias("one"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = persist(nodes.select("node", "size", "keys", "one.*"), "nodes")

    keyed = nodes.select("node", F.explode("keys").alias("key")).repartition("key")  # one exchange for both uses
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    members = persist(keyed.join(shared, "key").join(nodes.select("node", "size"), "node"), "members")
    star = members.where("node <> leader").groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))
    sizes = [nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size")) for x in ("a", "b")]
    pairs = _small(persist(star.unionByName(_fingerprint_pairs(nodes)).distinct(), "candidates")).join(sizes[0], "a").join(sizes[1], "b")
    pairs = persist(pairs.where(_allowed("a_size", "b_size")).select("a", "b"), "pairs")

    wanted = _small(persist(members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "wanted-nodes")).join(nodes, "node")
    wanted = persist(wanted.select("node", F.col("doc_id").alias("one_id"), F.col("text_hash").alias("one_hash")), "wanted")
    near = _small(wanted)
    named = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    texts = named.join(near, F.col("own_id").eqNullSafe(F.col("one_id")) & (F.col("own_hash") == F.col("one_hash"))).select("node", "text")
    repeated = not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    texts = texts.dropDuplicates(["node"]) if repeated else texts
    grams = persist_batched(texts.mapInArrow(_sets, "node long, grams binary"), "grams")

    links = _verify(pairs, grams, "links")
    found = connected_components(links)
    roots = persist(wanted.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "node-roots")
    free(found, links, pairs)
    unsettled = _unsettled(members, roots)
    for k in range(ROUNDS):
        links = _verify(_leader_pairs(unsettled, k), grams, "more-links")
        few = YIELD * links.count() < unsettled.select("node").distinct().count()
        roots, old = _merged(roots, links), unsettled
        unsettled = _unsettled(members, roots)
        free(old)
        if few:
            break  # what is left is mostly unlike: for the prefix join
    roots = _merged(roots, _verify(persist(_prefix_pairs(unsettled, grams), "prefix-pairs"), grams, "last-links"))
    out = rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    out = persist(out, "groups")
    free(rows, nodes, members, wanted, grams, unsettled, roots)
    return out


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    found = groups(docs)
    kept = persist(found.groupBy("root").agg(first.alias("first")), "kept")
    gone = found.join(kept.select("root", F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")), "root")
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))))
    gone = persist(gone.select("doc_id", "text_hash").distinct(), "gone")
    repeated = not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    free(found, kept)
    own_id, own_hash = free_name(docs, "own_id"), free_name(docs, "own_hash")
    gone = _small(gone.select(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash")))
    named = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    left = named.join(gone, named[own_id].eqNullSafe(gone["gone id"]) & (named[own_hash] == gone["gone hash"]), "left_anti")
    left = left.dropDuplicates([own_id, own_hash]) if repeated else left
    return left.select(*docs.columns)


by_value(__name__)
