"""Packing documents into sequences of bounded length: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so an instance is a count per size, at most ``capacity``
numbers whatever the data. On it, items are fixed for good while a set of one to three of them
dominates every other set that its largest item could be packed with (Martello and Toth): what any
other set holds could be exchanged for the mates in the set without needing more sequences. Equal
items are fixed together. The rest is packed by best fit, largest first, again by counts. The result
is a list of fillings, each with the number of sequences that are filled that way.

Spark then deals the pieces out: each gets its rank among those of its length (by buckets, with the
counts of earlier buckets added), and the rank picks filling, sequence and place.

Defined results: a null text is an empty one, whose only token is the separator; repeated rows are
packed one by one; null ids pass through; an empty table gives an empty result; only the two named
columns are read, so others may have any name. A document longer than the capacity is cut so that
all pieces but the first fill a sequence. Very long texts are encoded in slices, cut at a blank or
line end between two word characters, where no token can cross (those with special strings, whole).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdictflow.llm.packed import text_batches
from verdictflow.session import materialize

BATCH_CHARS = 1_000_000  # characters that a worker holds at once, or one longer text
BUCKET_ROWS = 50_000  # pieces whose ranks one window group finds, on average over all lengths
SHIFT = 44  # size << SHIFT | rank: sizes below 2 ** 19, ranks below 2 ** 44
CUT = re.compile(r"(?<=\w)[ \n](?=\w)")

Filling = tuple[tuple[tuple[int, int], ...], int]  # ((size, how many), ..), number of sequences


# --- the instance ----------------------------------------------------------------------------------

class Sizes:
    """A multiset of sizes."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({s: n for s, n in counts.items() if n > 0})
        self.order = sorted(self.count)

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.order[bisect_left(self.order, size)]

    def put(self, size: int) -> None:
        if not self.count[size]:
            insort(self.order, size)
        self.count[size] += 1

    def least(self, n: int, above: int = 0) -> list[int]:
        """The ``n`` smallest items larger than ``above`` (fewer, if there are fewer)."""
        out: list[int] = []
        for s in self.order[bisect_right(self.order, above):]:
            out += [s] * min(n - len(out), self.count[s])
            if len(out) == n:
                break
        return out

    def most(self, room: int) -> int:
        """The largest item of at most ``room``, or 0."""
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else 0

    def best_pair(self, room: int) -> int:
        """The largest sum of two items that is at most ``room``, or 0."""
        best, lo, hi = 0, 0, bisect_right(self.order, room) - 1
        while lo <= hi:
            total = self.order[lo] + self.order[hi]
            if total <= room and (lo < hi or self.count[self.order[lo]] > 1):
                best = max(best, total)
            if total <= room:
                lo += 1
            else:
                hi -= 1
        return best


def dominating_mates(sizes: Sizes, item: int, capacity: int) -> tuple[int, ...] | None:
    """The mates of ``item`` in a set that dominates all sets it can be in, if one of at most three exists.

    ``item`` itself is not among ``sizes``.
    """
    room = capacity - item
    few = sizes.least(3)
    if not few or few[0] > room:
        return ()  # nothing fits beside it
    one = sizes.most(room)
    if one == room or len(few) == 1 or few[0] + few[1] > room:
        return (one,)  # fills the room, or only one mate fits
    if len(few) > 2 and sum(few) <= room:
        return None  # three mates might fit
    if one >= sizes.best_pair(room):
        return (one,)  # replaces any two mates
    sizes.take(one)
    two = sizes.most(room - one)
    sizes.put(one)
    if not two:
        return None
    larger = sizes.least(2, above=two)
    if len(larger) < 2 or sum(larger) > room:
        return (one, two)  # of any two mates that fit, the smaller is at most ``two``
    return None


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Filling], dict[int, int]]:
    """The sequences that are fixed for good, and the sizes left over."""
    sizes, fixed, changed = Sizes(counts), [], True
    while changed:
        changed = False
        for item in reversed(list(sizes.order)):
            while sizes.count[item]:
                sizes.take(item)
                mates = dominating_mates(sizes, item, capacity)
                sizes.put(item)
                if mates is None:
                    break
                held = Counter((item, *mates))
                times = min(sizes.count[s] // n for s, n in held.items())
                fixed.append((tuple(held.items()), times))
                for s, n in held.items():
                    sizes.take(s, n * times)
                changed = True
    return fixed, dict(sizes.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit, largest items first: each goes where the least room is left over."""
    rooms: list[int] = []  # rooms of open sequences, ascending
    fillings: dict[int, list[Filling]] = {}

    def add(held: tuple, room: int, times: int) -> None:
        if times:
            if room not in fillings:
                insort(rooms, room)
            fillings.setdefault(room, []).append((held, times))

    for item in sorted(counts, reverse=True):
        n = counts[item]
        while n:
            at = bisect_left(rooms, item)
            if at < len(rooms):
                room = rooms[at]
                held, times = fillings[room].pop()
                if not fillings[room]:
                    del fillings[room], rooms[at]
            else:
                held, room, times = (), capacity, n
            each = room // item  # once chosen, a sequence stays the best fit until the item fits no more
            full = min(times, n // each)
            add((*held, (item, each)), room - each * item, full)
            n, times = n - full * each, times - full
            if n and times and n < each:
                add((*held, (item, n)), room - n * item, 1)
                n, times = 0, times - 1
            if held:
                add(held, room, times)
    return [f for some in fillings.values() for f in some]


class Packing:
    """Where the piece of a size with a rank among its equals goes."""

    def __init__(self, counts: dict[int, int], capacity: int):
        fixed, rest = dominance_reduction(counts, capacity)
        self.fixed = sum(n for _, n in fixed)
        next_rank: Counter[int] = Counter()
        rows, self.sequences = [], 0
        for held, times in fixed + best_fit(rest, capacity):
            offset = 0
            for size, each in held:
                rows.append((size << SHIFT | next_rank[size], each, self.sequences, offset))
                next_rank[size] += each * times
                offset += size * each
            self.sequences += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.each, self.first, self.offset = (np.ascontiguousarray(c) for c in table.T)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        key = size.astype(np.int64) << SHIFT | rank
        at = np.searchsorted(self.key, key, "right") - 1
        behind = key - self.key[at]
        return self.first[at] + behind // self.each[at], self.offset[at] + behind % self.each[at] * size


# --- documents -------------------------------------------------------------------------------------

def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens of a byte-level BPE model by their bytes, if their ids are in the order of the merges.

    Merging the pair that makes the token of the smallest id is then the same as merging by rules: a
    token made from another pair than its rule's could not have been left unmerged before.
    """
    shown = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}  # byte-level: printable as they are
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown.values()))}
    vocab = spec["model"]["vocab"]
    rules = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    single = [vocab.get(c, -1) for c in shown]
    made = [vocab.get(r, -1) for r in rules]
    if sorted(single) != list(range(256)) or made != list(range(256, 256 + len(rules))):
        return None
    return {bytes(shown[c] for c in t): vocab[t] for t in (*shown, *rules)}


class TextCoder:
    """Encodes texts as the library does that the vocabulary file is for.

    A byte-level vocabulary goes through the faster engine with the same pattern and the same merges.
    The pattern's character classes depend on an engine's Unicode tables, so they are compared for every
    character met; a text with a character that the two class differently, or a vocabulary of another
    kind, is encoded by the library itself.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    BESIDE = "a1!"  # a letter, a number and another sign: a character of their class joins them

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has its core only
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        fast = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added))
        ranks = merge_ranks(spec) if fast else None
        self.fast = self.engine(ranks) if ranks else None
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alike: set[str] = set()  # characters of the same class in both
        self.unlike: set[str] = set()

    def engine(self, ranks: dict[bytes, int]):
        import tiktoken

        return tiktoken.Encoding("texts", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def compare(self, chars: set[str]) -> None:
        """Sorts new characters into ``alike`` and ``unlike``: is a probe of two characters one piece or two?"""
        probes = [x + ch for ch in sorted(chars) for x in self.BESIDE]
        ranks = {bytes([i]): i for i in range(256)}
        ranks |= {p.encode(): 256 + i for i, p in enumerate(probes)}
        whole = self.engine(ranks)
        for ch in chars:
            here = [len(whole.encode_ordinary(x + ch)) == 1 for x in self.BESIDE]
            there = [len(self.lib.pre_tokenizer.pre_tokenize_str(x + ch)) == 1 for x in self.BESIDE]
            (self.alike if here == there else self.unlike).add(ch)

    def plain(self, text: str) -> bytes:
        """The ids of a text without special strings, as little-endian 32-bit numbers."""
        if self.fast is not None and (other := set(text) - self.alike):
            if new := other - self.unlike:
                self.compare(new)
            other &= self.unlike
        if self.fast is None or other:
            return b"".join(np.array(self.lib.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in slices(text))
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self.plain(text), "<u4")
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self.plain(text[at:m.start()]), self.special[m[0]]]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self.plain(text[at:])]), "<u4")


_CODERS: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    """One per worker and file."""
    if path not in _CODERS:
        _CODERS[path] = TextCoder(path)
    return _CODERS[path]


def vocabulary_path(name_or_path: str) -> str:
    """Resolved where it is used: a path is taken as it is, a bare name is a public tokenizer."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def slices(text: str, most: int = BATCH_CHARS // 2) -> Iterator[str]:
    """The text in slices of about ``most`` characters that are encoded like the whole."""
    at = 0
    while len(text) - at > most and (cut := CUT.search(text, at + most)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encoded(words: TextCoder, text: str, separator: int) -> np.ndarray:
    """The ids of a text, and the separator; long texts in slices."""
    if len(text) <= BATCH_CHARS or (words.cut is not None and words.cut.search(text)):
        parts = [words.ids(text)]
    else:
        parts = [words.ids(s) for s in slices(text)]
    return np.concatenate([*parts, np.array([separator], "<u4")])


def pieces(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str = "byte_bpe_50k.json", separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ``row``, which is unique."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = coder(vocabulary_path(vocabulary)), TaskContext.get().partitionId() << 40
        for docs in text_batches(batches, BATCH_CHARS):
            out = []
            for doc in docs:
                ids, start = encoded(words, doc["text"], separator), 0
                for i in range(-(-len(ids) // capacity)):
                    to = start + ((len(ids) - 1) % capacity + 1 if i == 0 else capacity)
                    out.append((doc["doc_id"], i, start, to - start, zlib.crc32(ids[start:to].tobytes()), row))
                    start, row = to, row + 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], doc_type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    doc_type = to_arrow_type(df.schema[id_col].dataType)
    return (df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long"))


def packed_pieces(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str = "byte_bpe_50k.json", separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver gets one count per length, at most ``capacity`` rows.
    """
    found = materialize(pieces(df, capacity, id_col, text_col, vocabulary, separator), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    plan = df.sparkSession.sparkContext.broadcast(Packing(counts, capacity))

    # rank among the pieces of one length: inside a bucket of rows, after the counts of earlier buckets
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.place(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (ranked.withColumn("at", place("length", F.col("before") + F.col("inside")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
