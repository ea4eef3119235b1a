"""Token counts and SentencePiece ids against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from verdictflow.llm import piece_tokenizer, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "\n", "a", "'s", "x'r", "'ll'l", "it's", "a\r\n\r\n b", "   ", "tab\tand\x0bmore\x1c", "é中　x", "🙂🙂",
         "a<|endoftext|>b  <|endoftext|> c", "<|endoftext|>", "<s></s>", "▁x▁", "aaaa" * 50, "ab" * 3000, "=" * 700, "\x00",
         "word " * 4000, "1234567890" * 40]


def noise(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(BYTE)
    texts = EDGES + noise(4000, "asteh'rvlmd  \n\t19!.é中 　\x1c\x85'’<|endoftext|>", 1)
    expected = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(BYTE)(texts).tolist() == expected


def test_counts_do_not_depend_on_chunks(monkeypatch):
    texts = EDGES + noise(300, "ab c'd\n9 !", 2)
    expected = token_counts.counter(BYTE)(texts).tolist()
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "SYNC", 3)
    monkeypatch.setattr(token_counts, "BLOCK", 100)
    monkeypatch.setattr(token_counts, "MEMO", 20)
    assert token_counts.Counter(BYTE)(texts).tolist() == expected


def test_state_maps_compose():
    """The map of a text is the composition of the maps of its halves."""
    nxt, _ = token_counts.split_table()

    def walk(s, classes):
        for c in classes:
            s = nxt[s, c]
        return s

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(11) for _ in range(rng.randrange(8))] for _ in range(2))
        assert all(walk(s, a + b) == walk(walk(s, a), b) for s in range(11))


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    mine = piece_tokenizer.tokenizer(PIECE)
    texts = EDGES + noise(4000, "asteethhaaa  \n\t19!.é中▁　\x1c\x85'’=-", 4)
    got = [x.tolist() for x in mine.ids(texts)]
    assert got == lib.encode(texts)
    assert [mine.decode(x) for x in got] == lib.decode(lib.encode(texts))


def test_pieces_do_not_depend_on_blocks(monkeypatch):
    mine = piece_tokenizer.tokenizer(PIECE)
    texts = EDGES + noise(200, "the a b\n", 5)
    expected = [x.tolist() for x in mine.ids(texts)]
    monkeypatch.setattr(piece_tokenizer, "BLOCK", 50)
    assert [x.tolist() for x in mine.ids(texts)] == expected


@pytest.mark.parametrize("op", ["counts", "digests", "encode"])
def test_operators_on_awkward_rows(spark, documents, op):
    docs = documents([(1, "Hello there"), (1, "Hello there"), (None, "x y"), (2, None), (3, "")])
    if op == "counts":
        got = sorted(map(tuple, token_counts.count_tokens(docs, limit=1).collect()), key=repr)
        lib = Tokenizer.from_file(BYTE)
        n = len(lib.encode("Hello there").ids)
        assert got == sorted([(1, 11, n, True), (1, 11, n, True), (None, 3, 2, True), (2, 0, 0, False), (3, 0, 0, False)], key=repr)
        assert token_counts.count_tokens(docs.limit(0)).count() == 0
        return
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    if op == "digests":
        got = {r.doc_id: r for r in piece_tokenizer.digests(docs).collect()}
        ids = lib.encode("Hello there")
        assert got[1].n_tokens == len(ids) and got[2].n_tokens == 0
        assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
        assert piece_tokenizer.digests(docs.limit(0)).count() == 0
    else:
        got = {r.doc_id: r for r in piece_tokenizer.encode(docs, keep=("b",)).collect()}
        assert got[None].ids == lib.encode("x y") and got[None].decoded == "x y" and got[2].ids == [] and got[2].b == "z"


def test_whole_table(spark, sf):
    import duckdb
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    lib, sp = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in token_counts.op9_token_counts(spark, sf).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    for r in piece_tokenizer.op4_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
