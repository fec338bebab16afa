"""Best-fit packing (operator 13): a configuration linear program over the length histogram.

Plan. One scan turns texts into token ids (``Encoder``: by distinct stretches between white space, a few MB of text
at a time) and cuts documents longer than a sequence; a row a piece is written, without texts. Pieces are numbered within their length while they are made: by scan task and place in it. The
histogram of lengths (at most ``capacity`` rows) is all that reaches the driver. From it comes a plan: how
often each *configuration* (lengths that fit one sequence together) is used. Pieces then find their sequence by
arithmetic: the counts of each task and length, summed over the tasks before, turn the number within the task
into one over the corpus, and the plan says which configuration takes the pieces numbered from where to where.

The linear program asks for the fewest configurations that cover the histogram. Multiplicative weights give
each length a price (its size times a weight that grows while it lags behind in coverage); a knapsack dynamic
program over the prices yields, in one pass, the best configuration through each length, and those within
``SLACK`` of the best of all are taken as far as uncovered lengths last. The prices prove a lower bound. The
fractional amounts are rounded to whole ones within the histogram; what rounding leaves, and pieces shorter than
``SAND`` tokens, go where they fit best, into the gaps of configurations first. The work depends on ``capacity`` alone.

Skew. A hot length is one row of the histogram; its pieces stay in their tasks' partitions, and the join that
carries the tasks' sums has a key a task and length. A very long text is cut like any other.

Defined results: null and empty texts have one token, the end. Rows are documents of their own, repeated or with
null ids too. Extra columns are ignored. An empty table gives an empty result. A document's first piece may be
short, all others are full; every piece is in exactly one sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import by_value, persist, table

CAPACITY, END = 2048, 0
ROUNDS, STEP, SLACK, SAND = 128, 0.05, 0.02, 32
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, task int, nth long"
_MOST_WORDS, _MOST_BYTES, _RUN = 400_000, 8 << 20, 256
_OTHER_MODELS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")  # tokens may not spell their word, or not always be the same

# Fixed value: the pattern that byte-level vocabularies split text by, for texts below U+0240 without U+001C to U+001F.
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u023f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"

# By byte: 1 where a unit may begin, 2 for other white space of one byte (and what Python takes for it), 0 for all else.
_KIND = np.zeros(256, np.uint8)
_KIND[[11, 12, 28, 29, 30, 31]], _KIND[[9, 10, 13, 32]] = 2, 1
_ODD = (np.arange(256) >= 0xC9) | (np.arange(256) >> 2 == 7)  # U+0240 and more, U+001C to U+001F


def _begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in UTF-8, and its end: at texts' ends and at a space, tab or line end after anything but white space."""
    kind, begins = _KIND[data], np.zeros(len(data) + 1, bool)
    np.logical_and(kind[1:] == 1, kind[:-1] == 0, out=begins[1:-1])
    at = np.flatnonzero(begins)
    at = at[data[at - 1] >= 128]  # white space of two bytes (C2 85, C2 A0) or three (E1 9A 80, E2 80 80 and so on)
    a, b, c = data[np.maximum(at - 3, 0)], data[np.maximum(at - 2, 0)], data[at - 1]
    white = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    begins[at[white]] = False
    begins[offsets] = True
    return np.flatnonzero(begins)


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class _Recent(dict):
    """Remembers the ids that it made in two generations of ``_MOST_WORDS``; what is used again moves to the newer one."""

    def __init__(self) -> None:
        self.old = {}

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of distinct texts."""
        if len(self) > _MOST_WORDS:
            self.old = dict(self)
            self.clear()
        if self.old:
            self.update((t, self.old[t]) for t in texts if t in self.old)
        new = [t for t in texts if t not in self]
        self.update(zip(new, self.make(new), strict=True))
        return list(map(self.__getitem__, texts))


class _Stretches(_Recent):
    """Ids of any stretches of texts, by the whole tokenizer."""

    def __init__(self, whole) -> None:
        super().__init__()
        self.whole = whole

    def make(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]


class _Words(_Recent):
    """Ids of words between splits of the pattern, by the tokenizer's merges."""

    def __init__(self, model) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        super().__init__()
        self.model = Tokenizer(model)
        self.model.pre_tokenizer, vocabulary = CharDelimiterSplit(" "), self.model.get_vocab(False)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.letters = str.maketrans({chr(b): letter for b, letter in _byte_letters().items()} | {"\xff": " "})  # no UTF-8 holds FF

    def make(self, words: list[str]) -> list[bytes]:
        out, held = [], b"\xff".join(map(str.encode, words)).decode("latin-1").translate(self.letters).split(" ")
        runs = [held[k : k + _RUN] for k in range(0, len(words), _RUN)]
        for run, encoding in zip(runs, self.model.encode_batch_fast([" ".join(r) for r in runs]), strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends, after = np.cumsum(list(map(len, run))), np.cumsum(self.sizes[ids])
            stops = np.searchsorted(after, ends)
            if len(after) and after[-1] == ends[-1] and (after[stops] == ends).all():
                data, stops = ids.tobytes(), [0, *(4 * stops + 4).tolist()]
                out += [data[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
            else:  # tokens that don't spell their words, as where a letter is missing
                out += [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(run)]
        return out


class _Units:
    """Ids of stretches of white space and what follows it up to the next white space."""

    def __init__(self, whole, added: list[str]) -> None:
        self.stretches, self.words, self.find = _Stretches(whole), _Words(whole.model), re.compile(_PATTERN).findall
        self.added = "|".join(map(re.escape, added))

    def of(self, units: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of units, none of them empty. Latin ones that begin with white space and end with something else stay apart
        when joined, so the pattern cuts them all at once and distinct words are encoded; the others are encoded whole."""
        data, offsets = _bytes(units)
        last = data[offsets[1:] - 1]
        joins = (_KIND[data[offsets[:-1]]] == 1) & (_KIND[last] == 0) & (last != 0x85) & (last != 0xA0) & ~np.logical_or.reduceat(_ODD[data], offsets[:-1])
        if self.added:
            joins &= ~pc.match_substring_regex(units, self.added).to_numpy(zero_copy_only=False)
        joined, others = units.filter(pa.array(joins)), units.filter(pa.array(~joins))
        ids = _held(self.stretches, others)
        if len(joined):
            data, offsets = _bytes(joined)
            words = pa.array(self.find(data.tobytes().decode()), pa.large_string())
            parts = _mapped(words, lambda distinct: _held(self.words, distinct))
            ids = pa.concat_arrays([_joined(parts, np.searchsorted(_bytes(words)[1], offsets)), ids])
        place = np.empty(len(units), np.int64)
        place[np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])] = np.arange(len(units))
        return ids.take(pa.array(place))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large strings or binaries without nulls, and where each begins; last, where they end."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _joined(ids: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The binaries from each bound up to the next, put together."""
    data, offsets = _bytes(ids)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets[bounds]), pa.py_buffer(data)])


def _held(recent: _Recent, texts: pa.LargeStringArray) -> pa.LargeBinaryArray:
    return pa.array(recent.of(texts.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())


def _mapped(values: pa.Array, of) -> pa.Array:
    """``of`` the distinct values, for each value."""
    coded = values.dictionary_encode()
    return of(coded.dictionary).take(coded.indices)


class Encoder:
    """Token ids of texts as little-endian bytes. Byte-level tokenizers never join what white space parts, so of the
    stretches between (units) only the distinct ones of a batch are looked at, and of those only words not seen
    before are encoded; other tokenizers get whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        plain = plain and spec["model"].get("type") == "BPE" and not any(map(spec["model"].get, _OTHER_MODELS)) and not any(map(spec.get, ("truncation", "padding")))
        plain = plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
        self.units = _Units(self.whole, [a["content"] for a in added]) if plain else None

    def ids(self, text: str) -> bytes:
        return b"".join(self.batch(pa.array([text])))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none), ``_MOST_BYTES`` of text at a time."""
        texts, first = texts.cast(pa.large_string()).fill_null(""), 0
        _, offsets = _bytes(texts)
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _MOST_BYTES, side="right")) - 1)
            some = texts[first:last]
            if self.units is None:
                yield from (array("I", self.whole.encode(t, add_special_tokens=False).ids).tobytes() if t else b"" for t in some.to_pylist())
            else:
                yield from self._some(some)
            first = last

    def _some(self, texts: pa.LargeStringArray) -> list[bytes]:
        data, offsets = _bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        begins = _begins(data, offsets)
        units = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data))
        return _joined(_mapped(units, self.units.of), np.searchsorted(begins, offsets)).to_pylist()


def _cut(path: str, capacity: int, end: int, keep_ids: bool):
    def cut(batches):
        encoder, task, end_id = Encoder(path), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch(batch.column("text")), strict=True):
                ids += end_id
                n = len(ids) // 4
                stop = n - capacity * ((n - 1) // capacity)
                start = piece = 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), part if keep_ids else None, task, seen[length]))
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return cut


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By room: the best price of sizes that fit (each as often as wished), the size taken last, and the room that
    the best choice really takes. ``sizes`` ascend; of equally good sizes the largest is taken."""
    best, taken, used = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64)
    upto, m = np.searchsorted(sizes, np.arange(capacity + 1), side="right"), len(sizes)
    down, price = sizes[::-1].copy(), prices[::-1].copy()
    for room in range(int(sizes[0]), capacity + 1):
        low = m - upto[room]
        worth = best[room - down[low:]] + price[low:]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], taken[room], used[room] = worth[k], m - 1 - (low + k), room
        else:
            best[room], used[room] = best[room - 1], used[room - 1]
    return best, taken, used


def _through_each(sizes: np.ndarray, taken: np.ndarray, used: np.ndarray, capacity: int) -> np.ndarray:
    """A row a size: the copies of each size in the best configuration that holds it."""
    copies = np.eye(len(sizes), dtype=np.int64)
    room = used[capacity - sizes]
    while len(go := np.flatnonzero(taken[room] >= 0)):
        k = taken[room[go]]
        copies[go, k] += 1
        room[go] = used[room[go] - sizes[k]]
    return copies


def linear_program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, slack: float = SLACK, sand: int = SAND) -> tuple[dict, float]:
    """Amounts of configurations, and a lower bound of the amount that any solution needs.

    ``counts[length]`` is the histogram. A configuration is a tuple of (length, copies)."""
    sizes = np.flatnonzero(counts)
    sizes = sizes[(sizes >= sand) & (sizes < capacity)]
    amounts: dict[tuple, float] = {}
    if not len(sizes):
        return amounts, 0.0
    wanted = counts[sizes].astype(float)
    missing, weight, mass, bound = wanted.copy(), np.ones(len(sizes)), wanted * sizes / capacity, 0.0
    for _ in range(rounds):
        share = missing / wanted
        if (share * mass).sum() < 0.01 * mass.sum():
            break
        weight *= np.exp(step * (share - (share * mass).sum() / mass.sum()))
        on = np.flatnonzero(missing > 1e-6 * wanted)
        s, price = sizes[on], (sizes * weight / capacity)[on]
        best, taken, used = _knapsack(s, price, capacity)
        if len(on) == len(sizes):  # prices by which no configuration is worth more than 1 bound any solution
            bound = max(bound, (wanted * price).sum() / best[capacity])
        copies = np.minimum(_through_each(s, taken, used, capacity), counts[s])
        worth = copies @ price
        left = missing[on]
        for k in np.argsort(-worth, kind="stable"):
            if worth[k] < (1 - slack) * best[capacity]:
                break
            at = np.flatnonzero(copies[k])
            amount = (left[at] / copies[k, at]).min()
            if amount > 0:
                left[at] -= amount * copies[k, at]
                key = tuple(zip(s[at].tolist(), copies[k, at].tolist(), strict=True))
                amounts[key] = amounts.get(key, 0.0) + amount
        missing[on] = left
    return amounts, bound


def rounded(counts: np.ndarray, amounts: dict) -> tuple[list[tuple[int, dict]], np.ndarray]:
    """Whole times of configurations, largest first, within the histogram, and the counts they leave."""
    left, out = counts.copy(), []
    for key, amount in sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0])):
        times = min(int(np.ceil(amount - 1e-9)), *(int(left[s]) // c for s, c in key))
        if times > 0:
            for s, c in key:
                left[s] -= times * c
            out.append((times, dict(key)))
    return out, left


def best_fit(counts: np.ndarray, capacity: int, begun: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    """Puts lengths, longest first, into the fullest sequences that hold them. Equal sequences move together,
    so the work is by kinds of sequences, not by pieces."""
    by_room: list[list] = [[] for _ in range(capacity + 1)]
    for times, held in begun:
        by_room[capacity - sum(s * c for s, c in held.items())].append((times, held))
    for size in range(capacity, 0, -1):
        n, room = int(counts[size]), size
        while n:
            while room < capacity and not by_room[room]:
                room += 1
            times, held = by_room[room].pop() if by_room[room] else (n, {})  # at full room: new sequences
            each = min(room // size, n)
            use = min(times, n // each)
            by_room[room - each * size].append((use, held | {size: held.get(size, 0) + each}))
            n -= use * each
            if times > use and held:
                by_room[room].append((times - use, held))
    return [kind for kinds in by_room for kind in kinds]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict]]:
    """How often each configuration is used: (times, {length: copies}), which takes every piece once."""
    amounts, _ = linear_program(counts, capacity)
    begun, left = rounded(counts, amounts)
    return best_fit(left, capacity, begun)


def _places(kinds: list[tuple[int, dict]]) -> dict[int, np.ndarray]:
    """By length, ascending rows (first number, copies, first sequence, offset): the pieces of this length numbered
    from there on fill this many places a sequence."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, held in kinds:
        offset = 0
        for size, copies in sorted(held.items(), reverse=True):
            rows.setdefault(size, []).append((taken.get(size, 0), copies, sequence, offset))
            taken[size] = taken.get(size, 0) + times * copies
            offset += size * copies
        sequence += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def place(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                of = np.flatnonzero(length == size)
                first, copies, begin, at = places[size][np.searchsorted(places[size][:, 0], number[of], side="right") - 1].T
                nth = number[of] - first
                sequence[of], offset[of] = begin + nth // copies, at + nth % copies * size
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return place


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, task, nth``, written: every document's ids and their end, cut."""
    return persist(docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, end, keep_ids), _PIECES), "pieces")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``: every piece and its place.

    ``path`` is a tokenizer's file, at the same place on all machines; ``ids`` are 32-bit, little-endian, and null without ``keep_ids``."""
    cut = pieces(docs, path, capacity, end, keep_ids)
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut.join(base, ["task", "length"]).select("*", (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(
        _place(_places(plan(counts, capacity))),
        "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, sequence_id long, offset long",
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.withColumn("length", F.col("length").cast("long")).drop("ids")


by_value(__name__)
