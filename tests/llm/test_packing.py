import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from vellum.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, FAST = Tokenizer.from_file(PATH), P.Encoder(PATH)


def tokens(text):
    return ([] if not text else WHOLE.encode(text, add_special_tokens=False).ids) + [0]


def check(rows, docs, capacity):
    """Pieces make up their documents, sequences are gapless and not too long, and hardly any could be saved."""
    wanted = Counter((i, tuple(tokens(t))) for i, t in docs)
    held, by_sequence = Counter(), defaultdict(list)
    open_, at = [], 0
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for ps in by_sequence.values():
        end = 0
        for offset, length in sorted(ps):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    expected = Counter()
    for (i, ids), times in wanted.items():
        first = len(ids) - capacity * ((len(ids) - 1) // capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += times
    held = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert held == expected
    return len(by_sequence), -(-sum(k[3] * n for k, n in expected.items()) // capacity)


def test_hard_cases(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices(["the", "Straße", "x1", "don't", "  ", "\n", "日本", "a" * 30], k=rng.randrange(0, 90)))) for k in range(300)]
    docs += [(1, None), (1, None), (None, "a b"), (5, ""), (6, "same text"), (6, "same text"), (7, "long " * 5000), (8, "<|endoftext|> x <|endoftext|>")]
    docs += [(1000 + k, "a hot text of which there are many") for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "1 as length", "'x' as task", "2 as piece", "3 as ids")
    for capacity in (64, 2048):
        rows = P.pack(frame, PATH, capacity).collect()
        used, least = check(rows, docs, capacity)
        assert used <= least + 2
        for r in rows:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "x " * 4095)]])
def test_few_or_no_documents(spark, docs):
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    used, least = check(rows, docs, 2048)
    assert used == least


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(P.op13(spark, sf_dir).collect(), docs, 2048)
    assert used <= least + 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB'sdtrelmv \n\t\r\x0b\x1c\x85\xa0 　é1²½_-ǅʼnɐя日👍<|endoftext|>"))))
def test_encoder_equals_the_tokenizer(text):
    assert FAST.ids(text) == struct.pack(f"<{len(tokens(text)) - 1}I", *tokens(text)[:-1])


def test_encoder_on_real_texts(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert FAST.ids(r.text or "") == struct.pack(f"<{len(tokens(r.text)) - 1}I", *tokens(r.text)[:-1])


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = P.Encoder(path)
    assert other.units is None
    assert other.ids("Hello  World") == struct.pack("<2I", *Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids)


def little(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list("aB'sd \n\t\r\x0b\x00\x1c\x85\xa0\u1680\u2003\u2028\u205f\u3000àᚁ耀é1²½_-ǅʼnɀɏɐя日👍<|endoftext|>"))), max_size=9), st.integers(1, 40))
def test_batches_equal_the_tokenizer(texts, most):
    kept = P._MOST_BYTES
    P._MOST_BYTES = most
    try:
        found = list(FAST.batch(pa.array([*texts, "cut off"], pa.string())[: len(texts)]))
        assert found == [little(tokens(t)[:-1]) for t in texts]
        assert list(FAST.batch(pa.array(["not read", *texts], pa.string())[1:])) == found
    finally:
        P._MOST_BYTES = kept


def test_units_begin_where_the_pattern_cuts():
    cut = re.compile(r"(?<=\S)(?=[ \n\t\r])")
    texts = [f"a{chr(c)}{s}{chr(c)}b" for c in [*range(0x3100), 0x65E5, 0x8000, 0x1F44D] for s in " \n\t\rx"]
    data, offsets = P._bytes(pa.array(texts, pa.large_string()))
    begins, ends = [], np.cumsum([len(t.encode()) for t in texts])
    for end, text in zip(ends, texts, strict=True):
        begins += [end - len(text[m.start() :].encode()) for m in cut.finditer(text)] + [end]
    assert P._begins(data, offsets).tolist() == [0, *begins]


def test_each_word_is_encoded_once(monkeypatch):
    """The check of round 3 found 488 CPU seconds a GB, most of them for words encoded again with each sign that followed them."""
    made = []
    monkeypatch.setattr(P._Words, "make", lambda self, words, make=P._Words.make: made.extend(words) or make(self, words))
    encoder, rng = P.Encoder(PATH), random.Random(3)
    words = ["".join(rng.choices(["th", "er", "ión", "ß", "on"], k=4)) for _ in range(300)]
    texts = ["\n".join(" ".join(w + rng.choice(["", ",", ".", "***", ")."]) for w in rng.choices(words, k=40)) for _ in range(5)) for _ in range(60)]
    for part in (texts[:40], texts[40:]):
        assert list(encoder.batch(pa.array(part))) == [little(tokens(t)[:-1]) for t in part]
    assert len(made) == len(set(made)) <= 2 * 300 + 20


def test_other_stretches_are_encoded_once(monkeypatch):
    made = []
    monkeypatch.setattr(P._Stretches, "make", lambda self, texts, make=P._Stretches.make: made.extend(texts) or make(self, texts))
    monkeypatch.setattr(P, "_MOST_BYTES", 100)
    encoder, texts = P.Encoder(PATH), ["два слова и ещё два слова, два"] * 5 + ["日本 два слова"]
    assert list(encoder.batch(pa.array(texts))) == [little(tokens(t)[:-1]) for t in texts]
    assert len(made) == len(set(made)) == 7  # both first stretches, and " слова", " и", " ещё", " два", " слова,"


def test_words_forgotten_or_not_spelt_are_encoded_right(monkeypatch, tmp_path):
    monkeypatch.setattr(P, "_MOST_WORDS", 3)
    monkeypatch.setattr(P, "_RUN", 2)
    encoder = P.Encoder(PATH)
    for text in ("one two three four five", "one six two seven", "one eight nine ten", "six one two"):
        assert encoder.ids(text) == little(tokens(text)[:-1])
    small = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2, "Ġ": 3}, merges=[("a", "b")]))  # without letters for other bytes
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    small.save(str(tmp_path / "small.json"))
    encoder = P.Encoder(str(tmp_path / "small.json"))
    assert encoder.units is not None
    for text in ("ab aab cab c abc ab", " c", "c", " ab c"):
        assert encoder.ids(text) == little(small.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 10**6), max_size=40))
def test_plans_take_every_piece_once(histogram):
    counts = np.zeros(101, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    kinds, taken = P.plan(counts, 100), Counter()
    for times, held in kinds:
        assert times > 0 and sum(s * c for s, c in held.items()) <= 100
        for s, c in held.items():
            taken[s] += times * c
    assert taken == Counter(histogram)


def test_linear_program_bounds_and_covers():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 200_000).astype(int), 1, 2048), minlength=2049)
    amounts, bound = P.linear_program(counts, 2048)
    covered = Counter()
    for held, amount in amounts.items():
        assert sum(s * c for s, c in held) <= 2048
        for s, c in held:
            covered[s] += amount * c
    assert all(covered[s] <= counts[s] * (1 + 1e-9) for s in covered)
    assert sum(s * x for s, x in covered.items()) > 0.5 * (counts * np.arange(2049)).sum()
    used, mass = sum(t for t, _ in P.plan(counts, 2048)), (counts * np.arange(2049)).sum()
    assert bound <= used <= -(-mass // 2048) * 1.002
