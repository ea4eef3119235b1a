"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A batch of texts is normalised as the model says and cut where no vocabulary piece can cross. The
distinct segments of the batch become one flat array of symbol ids. In each round every segment
looks up its adjacent pairs, takes its best ranked pair, merges the leftmost occurrences of it, and
the array is compacted; segments without a pair left drop out. Symbols outside the vocabulary become
byte pieces. The ids go through the library's ``decode``.

Defined results: a null text is encoded as empty (no ids, empty decoded text); repeated rows are
encoded independently and all stay; an empty table gives an empty result; only the two named columns
are read, so other columns may have any name; null ids pass through; texts of any length are encoded
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdictflow.llm.packed import text_batches

MARK = "▁"
BLOCK = 4_000_000  # characters encoded at once; bounds the memory of a worker
NONE = np.int32(2**31 - 1)


class PieceTokenizer:
    """Encodes with the vocabulary of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train, kinds = spec.normalizer_spec, spec.trainer_spec, spec.SentencePiece
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.treat_whitespace_as_suffix or train.model_type != 2 or not train.byte_fallback
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)):
            raise ValueError(f"{path}: only plain BPE models with byte fallback are handled")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.bytes = np.array([next(i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE and int(p.piece[1:-1], 16) == b)
                      for b in range(256)], np.int32)
        order = sorted(ids, key=lambda p: -spec.pieces[ids[p]].score)
        # equal scores merge leftmost first, whichever piece they make: they share a rank
        rank, ranks = {}, {}
        for p in order:
            rank[p] = ranks.setdefault(spec.pieces[ids[p]].score, len(ranks))
        self.size = len(spec.pieces)
        self.decimal = list(map(str, range(self.size)))
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * self.size + ids[p[k:]]] = (rank[p], i, p)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.to = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        # all occurrences of a pair may merge in one round unless the piece they make could at once
        # merge further at a better (or the same) rank; then only the leftmost one may
        best = np.full(self.size, NONE, np.int32)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(best, side, self.rank)
        self.alone = best[self.to] <= self.rank
        by_rank: dict[int, set[int]] = {}
        for r, t in zip(self.rank.tolist(), self.to.tolist(), strict=True):
            by_rank.setdefault(r, set()).add(t)
        self.alone |= np.array([len(by_rank[r]) > 1 for r in self.rank.tolist()], bool)
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.table = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.table[ord(c)] = i
        inner = {c for p in ids if len(p) > 1 for c in p}
        breaks = "".join(c for c in "\n\t\r" if c not in inner)
        if any(MARK in p.lstrip(MARK) for p in ids):
            self.cut = re.compile(r"(?s).+")
        else:
            off = re.escape(breaks)
            self.cut = re.compile(f"{MARK}+[^{MARK}{off}]*|[^{MARK}{off}]+" + (f"|[{off}]+" if off else ""))

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``keys``, or -1; symbols outside the vocabulary are negative."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over symbols ``sym`` of segments ``seg`` (ascending)."""
        done_sym, done_seg = [], []
        pair = np.full(len(sym), -1, np.int64)  # of a symbol with the next of its segment
        if len(sym) > 1:
            pair[:-1] = np.where(seg[1:] == seg[:-1], self.look(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[first, len(seg)])
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            live = least != NONE
            if not live.all():  # compaction: finished segments drop out
                done_sym.append(sym[~live])
                done_seg.append(seg[~live])
                sym, seg, pair, rank, least = sym[live], seg[live], pair[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            # leftmost first: of a run of overlapping pairs every second one merges
            run = np.r_[True, (np.diff(at) > 1) | (seg[at[1:]] != seg[at[:-1]])]
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            if (single := self.alone[pair[at]]).any():
                lead = np.r_[True, seg[at[1:]] != seg[at[:-1]]]
                at = at[lead | ~single]
            sym[at] = self.to[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            sym, seg, pair = sym[keep], seg[keep], pair[keep]
            # only pairs beside a merged symbol changed
            at = new[at]
            changed = np.zeros(len(sym) + 1, bool)
            changed[at] = changed[at - 1] = True  # a pair before the first symbol falls on the spare place
            pair[changed[:-1]] = -1
            again = np.flatnonzero(changed[:-2])
            again = again[seg[again] == seg[again + 1]]
            pair[again] = self.look(sym[again], sym[again + 1])
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments, end to end, and where each begins (and the last ends)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        seg = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.table[points]
        # outside the vocabulary: negative, never merges
        sym, seg = self.merge(np.where(sym < 0, -1 - points.astype(np.int32), sym), seg)
        if (out := sym < 0).any():
            raw = [chr(-1 - x).encode() for x in sym[out].tolist()]
            count = np.ones(len(sym), np.int64)
            count[out] = list(map(len, raw))
            sym, seg, out = np.repeat(sym, count), np.repeat(seg, count), np.repeat(out, count)
            sym[out] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.searchsorted(seg, np.arange(len(words) + 1))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        block, size = [], 0
        for i, text in enumerate(texts):
            block.append(self.cut.findall((self.prefix + text.replace(" ", MARK)) if text else ""))
            size += len(text)
            if size > BLOCK or i + 1 == len(texts):
                yield from self.block(block)
                block, size = [], 0

    def block(self, block: list[list[str]]) -> Iterator[np.ndarray]:
        every = list(chain.from_iterable(block))
        words = list(dict.fromkeys(every))
        index = dict(zip(words, range(len(words)), strict=True))
        which = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)))
        del every, index
        sym, begin = self.words(words)
        size = np.diff(begin)[which]
        stop = np.cumsum(size)
        flat = sym[np.repeat(begin[which] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        at = 0
        for e in ends.tolist():
            to = int(stop[e - 1]) if e else 0
            yield flat[at:to]
            at = to

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One model per worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def model_path(name_or_path: str) -> str:
    """Resolved where it is used: a path is taken as it is, a bare name is a public tokenizer."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           model: str = "piece_bpe_32k.model", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array of int), decoded (string) and the columns ``keep``."""

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(model_path(model))
        for texts in batches:
            ids = list(t.ids(texts.tolist()))
            yield pd.DataFrame({"ids": ids, "decoded": [t.decode(x.tolist()) for x in ids]})

    return (df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *keep)
            .select("doc_id", both("_t").alias("_b"), *keep)
            .select("doc_id", F.size("_b.ids").cast("long").alias("n_tokens"), "_b.ids", "_b.decoded", *keep))


def round_trips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model",
                batch_chars: int = 500_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array of int) and round_trip, whether they decode to its text.

    A worker holds the texts and ids of about ``batch_chars`` characters, or of one longer text.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model_path(model))
        for rows in text_batches(batches, batch_chars):
            ids, same = [], []
            for row, x in zip(rows, t.ids([r["text"] for r in rows]), strict=True):
                ids.append(x)
                same.append(t.decode(x.tolist()) == row["text"])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": [r["doc_id"] for r in rows], "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), "round_trip": same}, schema)

    kind = df.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                        ("round_trip", pa.bool_())])
    return (df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(work, f"doc_id {kind.simpleString()}, n_tokens long, ids array<int>, round_trip boolean"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (decoded text in UTF-8), both in lower-case hex."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(model_path(model))
        for texts in batches:
            rows = [(len(ids), sha256(",".join(map(t.decimal.__getitem__, ids))), sha256(t.decode(ids)))
                    for ids in map(np.ndarray.tolist, t.ids(texts.tolist()))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return (df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
            .select("doc_id", digest("t").alias("d")).select("doc_id", "d.*"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
