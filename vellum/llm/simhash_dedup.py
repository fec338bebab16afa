"""SimHash near-dedup (operator 7) with vantage-point trees.

A fingerprint has bit b set if more than half of the text's shingle hashes do. Distinct
fingerprints are searched for pairs within ``radius`` bits:

1. A bounded sample (``SAMPLE``) fixes the top of a vantage-point tree: each node holds a
   fingerprint and a distance; nearer fingerprints go left, the others right. The tree gets one
   leaf for about ``SHARD`` fingerprints, as far as the sample tells them apart. Shards that are larger get a tree of their
   own sample, level by level, so a shard keeps its size as the corpus grows, unless its fingerprints lie too close together.
2. Every fingerprint walks down the tree. By the triangle inequality a pair cut apart by a node has
   its right member within ``radius`` of the boundary, so exactly those also go left: each pair
   within the radius meets in some shard and no pair is missed.
3. A shard goes on splitting by vantage points until at most ``LEAF`` are left, compares those
   exactly, and sends one edge a fingerprint to the smallest of its local component (never all
   pairs). Where no vantage point splits a set, it is compared block by block.
4. Components are joined over the shards by contraction.

Documents join components through their fingerprint only, so exact copies, however many, never
meet in one task.

Defined results: null and wordless texts have fingerprint 0 and link like any other; texts with
fewer words than a shingle hash as one; a null ``doc_id`` is carried and never becomes a
``component_id`` unless all ids of the component are null; repeated rows give repeated rows; extra
columns are ignored by ``components`` and kept by ``keep_one_of_each``; an empty table gives an
empty result. A very long text is hashed whole; a bit that exactly half of the hashes have is 0.
"""

from __future__ import annotations

from ast import literal_eval

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import LOWER, UPPER, by_value, persist, table
from vellum.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
SAMPLE, SHARD, LEAF, LEVELS, BLOCK = 20_000, 16_384, 512, 8, 512
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CHUNK = 1 << 17


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        codes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)), np.dtype("<u8"))
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(fps.view(np.int64))], names=[*(c for c in batch.schema.names if c != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp``: fp is the unsigned fingerprint's bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints(width), "doc_id long, text_hash long, fp long")


def _split_point(distance: np.ndarray, radius: int) -> int | None:
    """The distance between the 30 and 70 % quantiles with the fewest fingerprints just beyond it."""
    seen = np.bincount(distance, minlength=65 + radius)
    inner = np.cumsum(seen)
    n = len(distance)
    at = [m for m in range(64) if 0.3 * n <= inner[m] <= 0.7 * n] or [int(np.searchsorted(inner, n / 2))]
    best = min(at, key=lambda m: inner[min(64, m + radius)] - inner[m])
    return None if inner[min(64, best + radius)] > 0.9 * n or inner[best] == 0 else best


def _node(fps: np.ndarray, radius: int) -> tuple[int, int] | None:
    for k in range(8):
        vantage = fps[(k * 7919 + len(fps) // 2) % len(fps)]
        if (m := _split_point(np.bitwise_count(fps ^ vantage), radius)) is not None:
            return int(vantage), m
    return None


def top_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, distance, left, right); a child below 0 is leaf -child - 1."""
    nodes: list = []
    found = 0

    def grow(fps: np.ndarray, n: int) -> int:
        nonlocal found
        node = _node(fps, radius) if n > 1 and len(fps) >= 64 else None
        if node is None:
            found += 1
            return -found
        at = len(nodes)
        nodes.append(None)
        near = np.bitwise_count(fps ^ np.uint64(node[0])) <= node[1]
        nodes[at] = (*node, grow(fps[near], n - n // 2), grow(fps[~near], n // 2))
        return at

    return nodes if grow(sample, leaves) >= 0 else []


def route(fps: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in fps and the shards they go to."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    out, todo = [], [(0, np.arange(len(fps)))]
    while todo:
        at, who = todo.pop()
        if at < 0:
            out.append((who, np.full(len(who), -at - 1)))
            continue
        vantage, m, left, right = nodes[at]
        d = np.bitwise_count(fps[who] ^ np.uint64(vantage))
        todo += [(left, who[d <= m + radius]), (right, who[d > m])]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _block_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """Smallest linked position for each fingerprint, closed over links; compared in blocks of ``BLOCK`` by ``BLOCK``,
    whose links are never listed: of copies within few bits nearly all pairs link."""
    n, label = len(fps), np.arange(len(fps))
    while True:
        new = label.copy()
        for a in range(0, n, BLOCK):
            least = new[a : a + BLOCK]
            for b in range(0, n, BLOCK):
                near = np.bitwise_count(fps[a : a + BLOCK, None] ^ fps[None, b : b + BLOCK]) <= radius
                np.minimum(least, np.where(near, label[b : b + BLOCK], n).min(1), out=least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def local_edges(fps: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """One edge from each linked fingerprint to the first of its component, leaf by leaf."""
    edges, todo = set(), [np.sort(fps)]
    while todo:
        part = todo.pop()
        node = _node(part, radius) if len(part) > LEAF else None
        if node is not None:
            d = np.bitwise_count(part ^ np.uint64(node[0]))
            todo += [part[d <= node[1] + radius], part[d > node[1]]]
        elif len(part) > 1:
            label = _block_components(part, radius)
            linked = label != np.arange(len(part))
            edges.update(zip(part[linked].tolist(), part[label[linked]].tolist(), strict=True))
    return edges


def _routed(nodes: list, radius: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            at, shard = route(fps, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fps[at].view(np.int64))], names=["shard", "fp"])

    return run


def _searched(radius: int):
    def run(rows: pa.Table) -> pa.Table:
        edges = local_edges(rows.column("fp").to_numpy().view(np.uint64), radius)
        both = np.array(sorted(edges), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": both[:, 0].copy(), "b": both[:, 1].copy()})

    return run


def _grown(radius: int):
    """A shard's own tree, from its sample: ``shard, tree``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sample = rows.column("fp").to_numpy().view(np.uint64)
        nodes = top_tree(np.sort(sample), -(-int(rows.column("n")[0].as_py()) // SHARD), radius)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([repr(nodes).encode() if nodes else None], pa.binary())})

    return run


def _split(radius: int):
    """A piece of an oversized shard walks down that shard's tree."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        fps, shard = rows.column("fp").to_numpy().view(np.uint64), rows.column("shard")[0].as_py() if len(rows) else 0
        tree = trees.column("tree")[0].as_py() if len(trees) else None
        at, leaf = route(fps, literal_eval(tree.decode()) if tree else [], radius)
        below = np.array([xxhash.xxh64_intdigest(f"{shard}/{k}") - (1 << 63) for k in range(int(leaf.max()) + 1)], np.int64) if len(leaf) else leaf
        return pa.table({"shard": pa.array(below[leaf] if len(leaf) else leaf, pa.int64()), "fp": pa.array(fps[at].view(np.int64), pa.int64())})

    return run


def _deepened(routed: DataFrame, radius: int) -> DataFrame:
    """``shard, fp`` with every shard of over ``4 * SHARD`` dealt on by a tree of its own sample, level by level, until
    none is left that a tree still splits."""
    done, level, before = None, 0, None
    while True:
        sizes = persist(routed.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        big = sizes.where(F.col("n") > 4 * SHARD)
        most = big.agg(F.max("n")).first()[0]
        if most is None or level == LEVELS or (before is not None and most > 0.95 * before):
            return routed if done is None else done.unionByName(routed)
        small = routed.join(big, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        rest = routed.join(big, "shard")
        drawn = rest.where(F.pmod(F.xxhash64("fp", F.lit(level)), F.ceil(F.col("n") / SAMPLE)) == 0)
        trees = persist(drawn.groupBy("shard").applyInArrow(_grown(radius), "shard long, tree binary"), "trees")
        pieces = rest.select("shard", "fp", F.pmod(F.xxhash64("fp", F.lit("piece")), F.ceil(F.col("n") / SHARD)).alias("piece"))
        of_pieces = trees.join(big, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SHARD) - 1)).alias("piece"))
        before = most
        routed = persist(pieces.groupBy("shard", "piece").cogroup(of_pieces.groupBy("shard", "piece")).applyInArrow(_split(radius), "shard long, fp long"), "deeper")
        level += 1


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` to edges (a, b) whose closure is that of all pairs within ``radius`` bits."""
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = top_tree(sample, -(-n // SHARD), radius)
    routed = persist(fps.select("fp").mapInArrow(_routed(nodes, radius), "shard long, fp long"), "routed")
    return _deepened(routed, radius).groupBy("shard").applyInArrow(_searched(radius), "a long, b long")


def components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row a document: ``doc_id, text_hash, fp, component_id``."""
    rows = persist(fingerprints(docs, width), "fingerprints")
    distinct = persist(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    many = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 OR root IS NOT NULL")
    many = persist(many.select("fp", F.coalesce("root", "fp").alias("root"), "least"), "members")
    least = many.groupBy("root").agg(F.min("least").alias("component_id"))
    named = persist(many.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose document is the one of smallest id in its component, once each."""
    found = components(docs, width, radius).where("doc_id <=> component_id").groupBy("doc_id", "component_id")
    kept = persist(found.agg(F.min("text_hash").alias("kept_hash"), F.count("*").alias("n_rows")), "kept")
    kept = kept.select(F.col("doc_id").alias("kept_id"), "kept_hash", "n_rows")
    repeated = not kept.where("n_rows > 1").isEmpty()
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_hash"]), "left_semi")
    return left.dropDuplicates(["doc_id"]) if repeated else left


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


by_value(__name__)
