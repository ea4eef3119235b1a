"""Helpers for operators that match hashes across documents.

Hash rows are many and tiny, so they travel packed: a map task sorts its hashes by bucket and ships,
per bucket, one row of binary columns; a reduce task unpacks the rows of a bucket into arrays. The
number of buckets follows ``spark.sql.shuffle.partitions``, so a bucket stays a bounded share of the
data. Texts are fetched for chosen ids only: a Bloom filter of fixed size drops most other rows
before the join moves any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOOM = 17  # log2 of the number of 64-bit words of the filter: 1 MB, whatever the data
BATCH_CHARS = 4_000_000  # texts handled at once by a worker
SPREAD = 0x9E3779B97F4A7C15  # odd multiplier that spreads ids over buckets


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def places(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack(keys: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that has keys; ``columns`` (and the keys) as binary."""
    at = places(keys, n)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    ends = np.append(first[1:], len(keys))[:len(used)].tolist()
    out = {"bucket": pa.array(used, pa.int32())}
    for name, values in {"key": keys, **columns}.items():
        values = values[order]
        out[name] = pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def unpacked(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column if x), kind)


def per_doc(docs: np.ndarray, pos: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Positions by document: ids and int32 arrays as bytes."""
    order = np.argsort(docs, kind="stable")
    docs, pos = docs[order], pos[order].astype(np.int32)
    used, first = np.unique(docs, return_index=True)
    ends = np.append(first[1:], len(docs))[:len(used)].tolist()
    return used.tolist(), [pos[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[list[dict]]:
    """Rows in lists of about ``most`` characters of text."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), 256):
            for row in batch.slice(at, 256).to_pylist():
                rows.append(row)
                size += len(row["text"])
                if size > most:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, end to end, and where each document begins (and the last ends)."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*docs)}
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)), out=starts[1:])
    flat = map(known.__getitem__, chain.from_iterable(docs))
    return np.fromiter(flat, np.uint64, int(starts[-1])), starts


def windows(h: np.ndarray, length: int, factor: int = SPREAD) -> np.ndarray:
    """Hash of the ``length`` words from each place (as if the array went on with zeros)."""
    out, done, power = np.zeros(len(h), np.uint64), 0, 1
    part, size, step = h, 1, factor
    rest = length
    while rest:  # by doubling: the binary digits of the length
        if rest & 1:
            moved = np.zeros(len(h), np.uint64)
            moved[:max(0, len(h) - done)] = part[done:] if done < len(h) else 0
            out = out + moved * np.uint64(power)
            done, power = done + size, power * step % 2 ** 64
        rest >>= 1
        if rest:
            moved = np.zeros(len(h), np.uint64)
            moved[:max(0, len(h) - size)] = part[size:] if size < len(h) else 0
            part = part + moved * np.uint64(step)
            size, step = 2 * size, step * step % 2 ** 64
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def suspects(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``_near``: false only if the id is surely not among ``ids`` (doc_id).

    The broadcast side is a Bloom filter: at most 2 ** BLOOM rows.
    """
    def place(c: str):
        h = F.xxhash64(F.col(c).cast(kind))
        return F.pmod(h, F.lit(1 << BLOOM)).cast("int"), F.pmod(F.shiftright(h, BLOOM), F.lit(64)).cast("int")

    kind = ids.schema["doc_id"].dataType
    bit = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    (word, spot), (there, at) = place(id_col), place("doc_id")
    bloom = (ids.select(there.alias("_word"), F.element_at(bit, at + 1).alias("b")).groupBy("_word")
             .agg(F.bit_or("b").alias("_bits")))
    near = F.coalesce(F.col("_bits").bitwiseAND(F.element_at(bit, spot + 1)) != 0, F.lit(False))
    return (docs.withColumn("_word", word).join(F.broadcast(bloom), "_word", "left")
            .withColumn("_near", near).drop("_word", "_bits"))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted``, both by doc_id; ``wanted`` has each id once."""
    return suspects(docs, wanted).filter("_near").drop("_near").join(wanted, "doc_id")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` but those whose id is among ``ids`` (doc_id); rows that are surely kept stay where they are."""
    seen = suspects(docs, ids, id_col)
    gone = ids.select(F.col("doc_id").alias("_gone"))
    check = seen.filter("_near").drop("_near").join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    return seen.filter(~F.col("_near")).drop("_near").unionByName(check)
