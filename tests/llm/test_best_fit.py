"""Packing: the reduction against exact packing of small instances, the query against the library."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdictflow.llm import best_fit as B

from .conftest import rows

CODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def fewest(items, capacity):
    """Fewest sequences, by trying every set for the largest item."""
    @cache
    def solve(left):
        if not left:
            return 0
        best, rest = len(left), left[1:]

        def extend(at, room, kept):
            nonlocal best
            best = min(best, 1 + solve(kept + rest[at:])) if best > 1 else best
            for i in range(at, len(rest)):
                if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                    extend(i + 1, room - rest[i], kept + rest[at:i])
        extend(0, capacity - left[0], ())
        return best
    return solve(tuple(sorted(items, reverse=True)))


def total(fillings):
    return sum(n for _, n in fillings)


def items_of(fillings):
    out = Counter()
    for held, times in fillings:
        for size, n in held:
            out[size] += n * times
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=11), st.integers(30, 45))
def test_reduction_keeps_the_fewest(items, capacity):
    fixed, rest = B.dominance_reduction(Counter(items), capacity)
    assert items_of(fixed) + Counter(rest) == Counter(items)
    assert all(sum(s * n for s, n in held) <= capacity for held, _ in fixed)
    assert total(fixed) + fewest(list(Counter(rest).elements()), capacity) == fewest(items, capacity)


def plain_best_fit(items, capacity):
    rooms = []
    for item in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= item]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - item)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_best_fit_by_counts(items, capacity):
    """Fillings by counts leave the rooms that item by item best fit leaves."""
    found = B.best_fit(Counter(items), capacity)
    rooms = [capacity - sum(s * n for s, n in held) for held, times in found for _ in range(times)]
    assert sorted(rooms) == plain_best_fit(items, capacity)
    assert items_of(found) == Counter(items)


@pytest.mark.parametrize("seed", range(4))
def test_places(seed):
    """Each rank of each size has its own place; sequences are gapless and few."""
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(5, 1.5)) + 1) for _ in range(20000))
    counts[2048] += 300
    plan = B.Packing(counts, 2048)
    held = defaultdict(list)
    for size, n in counts.items():
        for s, o in zip(*(x.tolist() for x in plan.place(np.full(n, size), np.arange(n))), strict=True):
            held[s].append((o, size))
    assert sorted(held) == list(range(plan.sequences))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
    bound = -(-sum(s * n for s, n in counts.items()) // 2048)
    assert 0 < plan.fixed < plan.sequences <= bound + 2


def expected(docs):
    out = Counter()
    for i, text in docs:
        ids = CODER.encode(text or "", add_special_tokens=False).ids + [0]
        start = 0
        while start < len(ids):
            rest = len(ids) - start
            length = rest if rest <= 2048 else (rest - 1) % 2048 + 1
            crc = zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            out[i, start, length, crc] += 1
            start += length
    return out


def test_query(spark, documents, tmp_path):
    rng = random.Random(1)
    words = ["the", "naïve", "🙂", "x1", "<|endoftext|>", "don't", "  ", "\n", "日本語", "e" * 50]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 60, 700, 3000])))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "no id"), (None, None)] + [(502, "again and again")] * 300
    docs += [(503, "a " * 2046 + "a"), (504, "a " * 2047 + "a"), (505, "w" * 9000)]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = B.op13_best_fit(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = got.collect()
    want = expected(docs)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == want
    by_start = defaultdict(set)
    for r in found:
        by_start[r.doc_id, r.start].add(r.piece)
    assert all(p == {0} for (i, s), p in by_start.items() if s == 0)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:] + [(sum(n for _, n in parts), 0)], strict=True))
        assert min(parts)[0] == 0 and sum(n for _, n in parts) <= 2048
    assert len(held) <= -(-sum(k[2] * n for k, n in want.items()) // 2048) + 1
    assert rows(B.packed_pieces(documents([]))) == []


def test_small_buckets(spark, documents, monkeypatch):
    """Ranks over many buckets are dense."""
    monkeypatch.setattr(B, "BUCKET_ROWS", 7)
    found = B.packed_pieces(documents([(i, "a" if i % 3 else "b c d") for i in range(200)])).collect()
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    assert len(held) == 1 and len(set(held[0])) == 200


PIECES = ["a", "é", " ", "  ", "\n", "1", "'s", "'re", "'", "語", "!", "\t", "<|endoftext|>", "_", " ", "x y", "²", "½", "Ⅷ", "\u2028", "\x1f",
          "\xa0", "🙂", "٣", "\u0301", "’s", "DON'T", "\r\n", "\u200d", "the", " the", "0"]


@pytest.mark.parametrize("most", [1, 7, 40])
def test_slices_encode_alike(most):
    rng = random.Random(most)
    for _ in range(200):
        text = "".join(rng.choices(PIECES, k=60))
        parts = list(B.slices(text, most))
        assert "".join(parts) == text
        ids = [x for p in parts for x in CODER.encode(p, add_special_tokens=False).ids]
        assert ids == CODER.encode(text, add_special_tokens=False).ids


def test_texts_encode_like_the_library():
    words, rng = B.TextCoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    assert words.fast is not None
    for k in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(40))) if k % 2 else "".join(
            chr(c) for c in rng.choices(range(0x3100), k=20) if not 0xD800 <= c < 0xE000)
        assert words.ids(text).tolist() == CODER.encode(text, add_special_tokens=False).ids
    for token in random.Random(2).sample(sorted(CODER.get_vocab()), 5000):  # also tokens that no pre-token holds
        text = CODER.decode([CODER.token_to_id(token)], skip_special_tokens=False)
        assert words.ids(text + "ing").tolist() == CODER.encode(text + "ing").ids
    words.alike.discard("q")
    words.unlike.add("q")  # as if the two engines disagreed
    assert words.ids("quite so").tolist() == CODER.encode("quite so").ids and words.ids("").tolist() == []
    other = B.TextCoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.ids("Two words").tolist() == other.lib.encode("Two words", add_special_tokens=False).ids


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(B, "BATCH_CHARS", 100)
    monkeypatch.setattr(B.slices, "__defaults__", (50,))
    words = B.TextCoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two " * 100, "x" * 300, "a b <|endoftext|> " * 30):
        assert B.encoded(words, text, 7).tolist() == CODER.encode(text, add_special_tokens=False).ids + [7]
