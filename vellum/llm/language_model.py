"""LM scoring (operator 6): a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf)

Both softmaxes have 32 outcomes, whose logits sum one hashed weight row a feature: the word before, the two before
(n-gram), the second before (skip) and the classes of the second and third before (skip); inside a class the row is
hashed with the class. Frequent words (a millionth of all tokens or more) fall into classes by spelling (clusters of letter
pairs), others by length and ending. A frequent class's ``OWN`` most frequent words are leaves of their own; all other words fall
into leaves by hash. P(word | leaf) is the word's share of the leaf's training tokens, less the class's Good-Turing share
of unseen words; the unseen word's probability is the mixture of those shares, so that all known words and the one
unseen word sum to 1.

Plan. Texts are split once, in the partitions they lie in, into groups of about 6 MB; nothing is dealt by a key, so no
key is hot. A group is written as its distinct words and its tokens as numbers into them; and it sends each distinct
word, as a hash with its training count there, to a bucket of the vocabulary. Buckets grow with the corpus; a group sends
rows only to buckets that it has words of, so rows grow with the corpus too, never with its square. Buckets sum the
counts over the corpus and answer each group, so no vocabulary is ever gathered. Over the buckets' training words k-means
fits the spelling clusters: every word by its count, as integer sums a pass. Groups and answers meet once in a written
table, which the ``ROUNDS`` of training and the scoring then read without a shuffle: iterative parameter mixing. In a
round every task runs Adagrad over minibatches of every position of its training documents, deltas are averaged by
tokens, in Spark in two levels, and only the average meets the driver. The last pass scores in sparse numpy batches.

Weight rows a feature kind (``slots``) double with each fourfold corpus beyond ``FULL`` tokens, up to ``MOST_SLOTS``, so that
a model (two tables of ``FEATURES`` kinds) stays between 4 and 64 MB; beyond that more histories share a row.

Defined results: null and empty texts are one end token; a very long text is a group of its own; repeated rows are
separate documents and each counts in training; words of equal counts are ordered by hash; a null ``doc_id`` counts as
the id text ''; with no training documents every score is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import LOWER, UPPER, by_value, free, persist, remainder, table, text_groups

CLUSTERS, LEAVES, OWN, TOP = 16, 32, 24, 1024
CLASSES = 2 * CLUSTERS
SLOTS, MOST_SLOTS, FULL = 1 << 12, 1 << 16, 1 << 28
FEATURES, ROUNDS, BATCH, RATE, COMMON = 4, 1, 4096, 0.15, 20
PAIRS, PASSES, UNIT = 509, 3, 1 << 20  # k-means over letter pairs, in sums of 1 / UNIT
GROUP = 6 << 20
RUN = 8  # rows of a minibatch's gradient that are added in turn
_LOWER = bytes.maketrans(UPPER.encode() + b"\t\n\v\f\r", LOWER.encode() + b" " * 5)
_END = b" "  # no word contains a space
_STOP = b"\n "  # the end token between texts whose white space is all spaces
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NEVER = -60.0  # logit of an outcome that has no training token


def slots(tokens: int) -> int:
    return min(MOST_SLOTS, SLOTS << ((int(tokens) // FULL).bit_length() + 1) // 2)


def _split(text: bytes) -> pa.LargeBinaryArray:
    """The stretches between spaces."""
    chars = np.frombuffer(text, np.uint8)
    inside = chars != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))  # where each stretch begins and ends
    offsets = np.cumsum(np.concatenate([[0], edges[1::2] - edges[::2]]))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])])


class Tokens:
    """The tokens of some texts: ``ids`` into ``words``, ``lengths`` of the texts; ``train`` marks tokens to learn from."""

    def __init__(self, texts: list, train: np.ndarray):
        found = _split(_STOP + b"".join(text.encode().translate(_LOWER) + b" " + _STOP if text else _STOP for text in texts)).dictionary_encode()
        ids, words = found.indices.to_numpy()[1:], [_END, *found.dictionary.to_pylist()[1:]]  # as a stop comes first, its number is 0
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.words, self.ids = [words[k] for k in order], number[ids]
        self.lengths = np.diff(np.flatnonzero(np.concatenate([[True], ids == 0])))
        self.train = np.repeat(train, self.lengths)
        self.codes = word_codes(self.words)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _by_bucket(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ordered by bucket; the buckets that have any, and where each begins."""
    with np.errstate(over="ignore"):
        of = (codes * _M2 >> np.uint64(24)) % np.uint64(n)
    order = np.argsort(of, kind="stable")
    full, begin = np.unique(of[order], return_index=True)
    return order, full.astype(np.int64), np.append(begin, len(order))


_ASKED = "g long, bucket int, words binary, counts binary, ids binary, lengths binary, train binary, doc_ids array<long>"


def _asked(g: int, doc_ids: list, texts: list, train: list, buckets: int) -> pa.RecordBatch:
    """A group's own row (bucket -1), and one row a bucket that it has words of."""
    train = np.array(train, bool)
    t = Tokens(texts, train)
    counts = np.bincount(t.ids[t.train], minlength=len(t.words)).astype(np.uint32)
    order, full, begin = _by_bucket(t.codes, buckets)
    parts = [order[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    none = [None] * len(parts)
    planes = t.ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 3 if len(t.words) <= 1 << 24 else 4].T.tobytes()  # bytes of equal weight together: they compress
    return pa.RecordBatch.from_pydict({
        "g": pa.array([g] * (len(parts) + 1), pa.int64()), "bucket": pa.array([-1, *full.tolist()], pa.int32()),
        "words": pa.array([b"\n".join(t.words), *(b"\n".join([t.words[k] for k in p]) for p in parts)], pa.binary()), "counts": pa.array([None, *(counts[p].tobytes() for p in parts)], pa.binary()),
        "ids": pa.array([planes, *none], pa.binary()), "lengths": pa.array([t.lengths.tobytes(), *none], pa.binary()),
        "train": pa.array([train.tobytes(), *none], pa.binary()), "doc_ids": pa.array([doc_ids, *none], pa.list_(pa.int64())),
    })


def _ask(buckets: int, most: int):
    def ask(batches):
        g, size, rows = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train")), strict=True):
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
                size += len(row[1] or "")
                if size >= most:
                    yield _asked(g, *rows, buckets)
                    g, size, rows = g + 1, 0, ([], [], [])
        if rows[0]:
            yield _asked(g, *rows, buckets)

    return ask


def _count(bucket: tuple, rows: pa.Table) -> pa.Table:
    """Answers to the groups, and one row (g = -1) of the bucket's sums and most frequent words."""
    words = [x.split(b"\n") for x in rows.column("words").to_pylist()]
    codes = [word_codes(x) for x in words]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
    every = np.concatenate(codes)
    known, first, at = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(at, counts, len(known)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, codes)])
    answers = [total[at[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    flat = [w for x in words for w in x]
    words, n = [flat[k] for k in first[total > 0]], total[total > 0]
    top = np.lexsort((known[total > 0], -n))[:TOP]
    none = [None] * len(codes)
    return pa.table({
        "g": pa.array([*rows.column("g").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket[0].as_py()] * (len(codes) + 1), pa.int32()), "totals": pa.array([*answers, None], pa.binary()),
        "n": pa.array([*none, int(n.sum())], pa.int64()), "v": pa.array([*none, len(n)], pa.int64()), "top": pa.array([*none, [{"c": int(n[k]), "word": words[k]} for k in top]], pa.list_(pa.struct([("c", pa.int64()), ("word", pa.binary())]))),
        "words": pa.array([*none, b"\n".join(words)], pa.binary()), "counts": pa.array([*none, n.tobytes()], pa.binary()),
    })


def _letter_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter pairs of each word in a row, and where each word begins."""
    spaced = np.frombuffer(b"".join(b" %b " % w for w in words), np.uint8).astype(np.int64)
    starts = np.cumsum([0, *(len(w) + 2 for w in words)])[:-1]
    return np.append(spaced[:-1] * 37 + spaced[1:] * 101, 32 * 138) % PAIRS, starts  # as if a word came after the last


def clusters(words: list[bytes], centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each word (by the mean of its letter pairs)."""
    out = []
    for a in range(0, len(words), 50_000):
        pairs, starts = _letter_pairs(words[a : a + 50_000])
        ends = np.append(starts[1:], len(pairs))
        out.append((np.add.reduceat(centres[pairs], starts) / (ends - starts)[:, None] - 0.5 * (centres**2).sum(0)).argmax(1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _cluster_sums(words: list[bytes], counts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of the words' pair shares (in ``UNIT``) by pair and nearest centre, weighted by count."""
    sums = np.zeros(PAIRS * CLUSTERS, np.int64)
    near = clusters(words, centres)
    for a in range(0, len(words), 50_000):
        pairs, starts = _letter_pairs(words[a : a + 50_000])
        lengths = np.diff(np.append(starts, len(pairs)))
        share = counts[a : a + 50_000] * UNIT // lengths
        sums += np.bincount(pairs * CLUSTERS + np.repeat(near[a : a + 50_000], lengths), np.repeat(share, lengths), len(sums)).astype(np.int64)
    return sums


def _first_centres(words: list[bytes]) -> np.ndarray:
    """Centres (pair by cluster) at these words."""
    centres = np.zeros((PAIRS, CLUSTERS), np.float32)
    for k in range(CLUSTERS if words else 0):
        pairs = _letter_pairs([words[k % len(words)]])[0]
        centres[:, k] = np.bincount(pairs, minlength=PAIRS) / len(pairs)
    return centres


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    sums = sums.reshape(PAIRS, CLUSTERS)
    mass = sums.sum(0)
    return np.where(mass > 0, sums / np.maximum(mass, 1), centres).astype(np.float32)


def fit_clusters(words: list[bytes], counts: np.ndarray | None = None) -> np.ndarray:
    """Centres (pair by cluster), by k-means over these words, in plain numpy."""
    counts = np.ones(len(words), np.int64) if counts is None else counts
    centres = _first_centres(sorted(words, key=xxhash.xxh64_intdigest)[:CLUSTERS])
    for _ in range(PASSES):
        centres = _moved(centres, _cluster_sums(words, counts, centres))
    return centres


def _words(batches):
    """Training words of the buckets, and their counts."""
    for batch in batches:
        for blob, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield blob.split(b"\n") if blob else [], np.frombuffer(n, np.int64)


def _lowest(batches):
    for words, _ in _words(batches):
        found = sorted((xxhash.xxh64_intdigest(w) - (1 << 63), w) for w in words)[:CLUSTERS]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], names=["code", "word"])


def _shares(centres: np.ndarray):
    def shares(batches):
        sums = np.zeros(PAIRS * CLUSTERS, np.int64)
        for words, counts in _words(batches):
            sums += _cluster_sums(words, counts, centres)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["at", "v"])

    return shares


def fit_to_all(sums: DataFrame) -> np.ndarray:
    """``fit_clusters`` over the training words of all buckets (``words, counts``)."""
    buckets = sums.select("words", "counts")
    first = buckets.mapInArrow(_lowest, "code long, word binary").orderBy("code").limit(CLUSTERS).collect()
    centres = _first_centres([bytes(r.word) for r in first])
    for _ in range(PASSES if first else 0):
        total = np.zeros(PAIRS * CLUSTERS, np.int64)
        for r in buckets.mapInArrow(_shares(centres), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():  # PAIRS * CLUSTERS rows
            total[r["at"]] = r.v
        centres = _moved(centres, total)
    return centres


class Model:
    """What training and scoring need; all of bounded size. ``top`` is (count, word) of the most frequent words."""

    def __init__(self, centres: np.ndarray, top: list[tuple[int, bytes]], tokens: int):
        self.centres, self.tokens, self.slots = centres, tokens, slots(tokens)
        self.weights = np.zeros((2, FEATURES, self.slots, CLASSES), np.float32)
        self.mass, self.once = np.zeros(CLASSES * LEAVES), np.zeros(CLASSES)
        codes = np.fromiter((xxhash.xxh64_intdigest(w) for _, w in top), np.uint64, len(top))
        classes = self._classes([w for _, w in top], np.array([c for c, _ in top], np.int64))
        own: dict[int, int] = {}
        held = [0] * CLASSES
        for k in np.lexsort((codes, [-c for c, _ in top])) if top else ():
            c = int(classes[k])
            if c >= CLUSTERS and held[c] < OWN:
                own[int(codes[k])] = held[c]
                held[c] += 1
        self.own_codes = np.array(sorted(own), np.uint64)
        self.own_leaves = np.array([own[c] for c in sorted(own)], np.int64)

    def _classes(self, words: list[bytes], total: np.ndarray) -> np.ndarray:
        frequent = np.flatnonzero((total << COMMON) >= max(self.tokens, 1))
        of = np.fromiter((len(w) * 7 + w[-1] * 5 + w[-2:][0] for w in words), np.int64, len(words)) % CLUSTERS
        of[frequent] = CLUSTERS + clusters([words[k] for k in frequent], self.centres)
        return of

    def places(self, words: list[bytes], codes: np.ndarray, total: np.ndarray) -> np.ndarray:
        """class * LEAVES + leaf of each word."""
        of = self._classes(words, total)
        rest = (codes >> np.uint64(8)).astype(np.int64)
        leaf = np.where(of < CLUSTERS, rest % LEAVES, OWN + rest % (LEAVES - OWN))
        if len(self.own_codes):
            at = np.minimum(np.searchsorted(self.own_codes, codes), len(self.own_codes) - 1)
            leaf = np.where((self.own_codes[at] == codes) & (of >= CLUSTERS), self.own_leaves[at], leaf)
        return of * LEAVES + leaf

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the classes and, a row a class, of their leaves without features."""
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1) / max(self.mass.sum(), 1)), _NEVER).astype(np.float32)
        return log(self.mass.reshape(CLASSES, LEAVES).sum(1)), log(self.mass).reshape(CLASSES, LEAVES)


def _short(codes: np.ndarray) -> np.ndarray:
    """The half of the words' hashes that histories are made of."""
    return (codes >> np.uint64(32)).astype(np.uint32)


def histories(codes: np.ndarray, classes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A hash a feature of the tokens at these positions, from the words' short codes; a text begins after end tokens."""
    place = (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[at]
    end = int(ids[-1]) if len(ids) else 0  # every text ends with it
    back = [np.where(place < k, end, ids[np.maximum(at - k, 0)]) for k in (1, 2, 3)]
    of, codes = classes.astype(np.uint64), codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        one, two = codes[back[0]] * _M2, codes[back[1]] * _M2
        rows = [one, one * _M1 ^ (two * _M2 >> np.uint64(7)), two, of[back[1]] * np.uint64(131) + of[back[2]] * np.uint64(17161) + np.uint64(7)]
        return [(r ^ (r >> np.uint64(32))) * _M1 for r in rows]


def rows_of(history: list[np.ndarray], n: int, inside: np.ndarray | None = None) -> list[np.ndarray]:
    """Weight rows of these features, hashed with a class where ``inside`` gives one."""
    with np.errstate(over="ignore"):
        if inside is not None:
            salt = (inside.astype(np.uint64) + np.uint64(1)) * _M2
            history = [(h ^ salt) * _M1 for h in history]
        return [((h >> np.uint64(40)) % np.uint64(n)).astype(np.uint16) for h in history]


def _exp_logits(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Exponentials of the sums of the features' weight rows, one feature at a time."""
    z = weights[0].take(rows[0], 0)
    one = np.empty_like(z)
    for k in range(1, len(rows)):
        z += weights[k].take(rows[k], 0, out=one, mode="clip")
    z += bias
    np.minimum(z, -_NEVER, out=z)
    return np.exp(z, out=z)


def _row_sums(g: np.ndarray, order: np.ndarray, begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of g's rows by stretch of ``order`` (stretches by falling length): a row more of all at once, ``RUN`` times; what
    is left of the long ones is cut into pieces of ``RUN``."""
    sums = g.take(order.take(begin), 0)
    for j in range(1, RUN):
        if not (n := int(np.count_nonzero(times > j))):
            return sums
        sums[:n] += g.take(order.take(begin[:n] + j), 0)
    if n := int(np.count_nonzero(times > RUN)):
        pieces = (times[:n] - 1) // RUN
        first = np.cumsum(pieces) - pieces
        at = np.repeat(begin[:n] - RUN * first, pieces) + RUN * np.arange(1, pieces.sum() + 1)
        size = np.minimum(RUN, np.repeat(begin[:n] + times[:n], pieces) - at)
        by = np.argsort((RUN - size).astype(np.uint8), kind="stable")
        part = np.empty((len(at), g.shape[1]), g.dtype)
        part[by] = _row_sums(g, order, at[by], size[by])
        sums[:n] += np.add.reduceat(part, first)
    return sums


def _learn(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], y: np.ndarray, bias: np.ndarray) -> None:
    """One Adagrad step of a softmax on a minibatch."""
    g = _exp_logits(weights, rows, bias)
    g /= np.einsum("ij->i", g)[:, None]  # not a matrix product: its threads would wait busily
    g.reshape(-1)[np.arange(len(y)) * g.shape[1] + y] -= 1
    for k, r in enumerate(rows):
        order = np.argsort(r, kind="stable")
        slot = r.take(order)
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        times = np.diff(np.append(begin, len(slot)))
        longest = np.argsort(len(y) - times if len(y) >> 16 else (len(y) - times).astype(np.uint16), kind="stable")
        begin, times = begin.take(longest), times.take(longest)
        step = _row_sums(g, order, begin, times)
        slot, own, square = slot.take(begin).astype(np.int64), weights[k], squares[k]
        times = times.astype(np.float32)
        seen = square.take(slot) + np.einsum("ij,ij->i", step, step) / (times * step.shape[1])
        square[slot] = seen
        step *= (RATE / np.sqrt(seen * times))[:, None]  # a row's gradient counts by the root of its positions
        new, whole = own.take(slot, 0), f"V{own.strides[0]}"
        new -= step
        np.put(own.view(whole).reshape(-1), slot, new.view(whole).reshape(-1))


_READY = "ids binary, lengths binary, train binary, doc_ids array<long>, codes binary, totals binary, places binary, mass array<double>, once array<double>"


def _ready(model: Model, buckets: int):
    """A group with its words' totals and places, and its training tokens by place (and those of words seen once, by class)."""

    def ready(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: rows.column(c)[0].as_py() for c in ("ids", "words", "lengths", "train", "doc_ids")}
        words = row["words"].split(b"\n")
        codes = word_codes(words)
        order, full, begin = _by_bucket(codes, buckets)
        total = np.zeros(len(codes), np.int64)
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            k = np.searchsorted(full, b)
            total[order[begin[k] : begin[k + 1]]] = np.frombuffer(x, np.int64)
        places = model.places(words, codes, total)
        ids, lengths, train = _tokens(row["ids"], row["lengths"], row["train"])
        counts = np.bincount(ids[train], minlength=len(codes))
        mass, once = np.bincount(places, counts, CLASSES * LEAVES), np.bincount(places // LEAVES, counts * (total == 1), CLASSES)
        return pa.table({
            **{c: pa.array([row[c]], pa.binary()) for c in ("ids", "lengths", "train")}, "codes": pa.array([_short(codes).tobytes()], pa.binary()), "doc_ids": pa.array([row["doc_ids"]], pa.list_(pa.int64())),
            "totals": pa.array([total.tobytes()], pa.binary()), "places": pa.array([places.astype(np.int16).tobytes()], pa.binary()),
            "mass": pa.array([mass.tolist()], pa.list_(pa.float64())), "once": pa.array([once.tolist()], pa.list_(pa.float64())),
        }).select([c.split()[0] for c in _READY.split(", ")])

    return ready


def _tokens(ids: bytes, lengths: bytes, train: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as numbers, lengths of the texts, and which tokens to learn from."""
    lengths = np.frombuffer(lengths, np.int64)
    planes = np.frombuffer(ids, np.uint8).reshape(-1, lengths.sum()).astype(np.int32)
    return sum(p << 8 * k for k, p in enumerate(planes)), lengths, np.repeat(np.frombuffer(train, bool), lengths)


def _groups(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("ids", "lengths", "train", "codes", "totals", "places", "doc_ids")}
            yield *_tokens(row["ids"], row["lengths"], row["train"]), np.frombuffer(row["codes"], np.uint32), np.frombuffer(row["totals"], np.int64), np.frombuffer(row["places"], np.int16).astype(np.int64), row


def learn_group(model: Model, weights: np.ndarray, squares: np.ndarray, ids, lengths, train, codes, places, seed: int = 7) -> int:
    """Adagrad over minibatches of every training position of a group, once; their number."""
    at = np.flatnonzero(train)
    np.random.default_rng(seed).shuffle(at)
    classes, leaves = np.divmod(places[ids[at]], LEAVES)
    history = histories(codes, places // LEAVES, ids, lengths, at)
    outer, inner = rows_of(history, model.slots), rows_of(history, model.slots, classes)
    prior, inside = model.priors()
    for a in range(0, len(at), BATCH):
        b = slice(a, a + BATCH)
        _learn(weights[0], squares[0], [r[b] for r in outer], classes[b], prior)
        _learn(weights[1], squares[1], [r[b] for r in inner], leaves[b], inside[classes[b]])
    return len(at)


_MIXED = "part int, salt int, n double, delta binary"


def _train(model: Model, salts: int):
    def train(batches):
        weights, squares, n = model.weights.copy(), np.full(model.weights.shape[:3], 1e-2, np.float32), 0
        for ids, lengths, learn, codes, _, places, _ in _groups(batches):
            n += learn_group(model, weights, squares, ids, lengths, learn, codes, places)
        if n:
            parts = (weights - model.weights).astype(np.float16).reshape(2 * FEATURES, -1)
            salt = TaskContext.get().partitionId() % salts
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([float(n)] * len(parts)), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["part", "salt", "n", "delta"],
            )

    return train


def _mix(kind):
    def mix(key: tuple, rows: pa.Table) -> pa.Table:
        """The average delta by tokens (float32 between the levels)."""
        n = np.array(rows.column("n").to_pylist())
        delta = sum(np.frombuffer(x, kind).astype(np.float32) * np.float32(k / n.sum()) for x, k in zip(rows.column("delta").to_pylist(), n, strict=True))
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([float(n.sum())]), "delta": pa.array([delta.tobytes()], pa.binary())})

    return mix


def score_group(model: Model, ids, lengths, codes, total, places) -> np.ndarray:
    """Natural log probability of each token."""
    mass = model.mass.reshape(CLASSES, LEAVES).sum(1)
    unseen = np.where(mass > 0, np.minimum(model.once / np.maximum(mass, 1), 0.95), 0.0)
    unseen = unseen if unseen.any() else np.where(mass > 0, 1.0 / (model.tokens + 1), 0.0)  # some mass for the unseen word
    classes = places // LEAVES
    fixed = np.log(np.maximum(total, 1)) - np.log(np.maximum(model.mass[places], 1)) + np.log1p(-unseen[classes])
    history = histories(codes, classes, ids, lengths, np.arange(len(ids)))
    of, leaf = classes[ids], (places % LEAVES)[ids]
    outer, inner = rows_of(history, model.slots), rows_of(history, model.slots, of)
    prior, inside = model.priors()
    out = np.empty(len(ids))
    for a in range(0, len(ids), BATCH):
        b = slice(a, a + BATCH)
        k = np.arange(len(ids[b]))
        z = _exp_logits(model.weights[0], [r[b] for r in outer], prior)
        norm = np.einsum("ij->i", z)
        y = _exp_logits(model.weights[1], [r[b] for r in inner], inside[of[b]])
        out[b] = np.log(z[k, of[b]] * y[k, leaf[b]] / (norm * np.einsum("ij->i", y))) + fixed[ids[b]]
        if len(new := np.flatnonzero(total[ids[b]] == 0)):
            out[a + new] = np.log((z[new] * unseen).sum(1) / norm[new])
    return out


def _score(model: Model, n: int, v: int):
    def score(batches):
        for ids, lengths, _, codes, total, places, row in _groups(batches):
            starts = np.cumsum(lengths) - lengths
            c = total[ids]
            own = score_group(model, ids, lengths, codes, total, places) / np.log(10) if n else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(~np.frombuffer(row["train"], bool)), pa.array(lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(lengths), n, np.int64)), pa.array(np.add.reduceat(np.log10((c + 1) / (n + (v + 1))), starts)), pa.array(np.add.reduceat(own, starts)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def score_texts(docs: DataFrame, train=None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``train`` is the condition
    (a Column) for the documents to learn from, all but every seventh hash of ids by default."""
    learn = remainder(F.col("doc_id"), 7) != 2 if train is None else train
    buckets = int(text_groups(docs))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(learn, F.lit(False)).alias("train"))
    asked = persist(rows.mapInArrow(_ask(buckets, GROUP), _ASKED), "groups")
    words = asked.where("bucket >= 0").select("g", "bucket", "words", "counts")
    answers = persist(words.groupBy("bucket").applyInArrow(_count, "g long, bucket int, totals binary, n long, v long, top array<struct<c:long,word:binary>>, words binary, counts binary"), "totals")
    sums = answers.where("g = -1")
    n, v = (x or 0 for x in sums.agg(F.sum("n"), F.sum("v")).first())
    top = sums.select(F.explode("top").alias("x")).select("x.*").orderBy(F.desc("c"), "word").limit(TOP).collect()
    model = Model(fit_to_all(sums), [(r.c, bytes(r.word)) for r in top], n)
    own = asked.where("bucket = -1").select("g", "ids", "words", "lengths", "train", "doc_ids")
    ready = persist(own.groupBy("g").cogroup(answers.where("g >= 0").select("g", "bucket", "totals").groupBy("g")).applyInArrow(_ready(model, buckets), _READY), "ready")
    free(asked, answers)
    for name, into in (("mass", model.mass), ("once", model.once)):
        for r in ready.select(F.posexplode(name).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():  # at most CLASSES * LEAVES rows
            into[r.k] = r.x
    salts = isqrt(ready.rdd.getNumPartitions()) + 1
    for _ in range(ROUNDS if n else 0):
        deltas = ready.mapInArrow(_train(model, salts), _MIXED)
        mixed = deltas.groupBy("part", "salt").applyInArrow(_mix(np.float16), _MIXED).groupBy("part").applyInArrow(_mix(np.float32), _MIXED)
        for r in mixed.collect():  # a row a feature kind of each softmax
            model.weights.reshape(2 * FEATURES, -1)[r.part] += np.frombuffer(r.delta, np.float32)
    return ready.mapInArrow(_score(model, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


by_value(__name__)
