"""Substring dedup: words inside long passages that an earlier document has are removed.

A passage is ``window`` consecutive words. Hashing all windows of all documents would move as many
rows as there are words. Instead, anchors of ``window - period + 1`` words are hashed only where the
position modulo ``period`` is in a difference cover: for any two positions there is a shift below the
period that takes both into the cover, so two equal windows always hold one equal anchor at aligned
places. Anchors that occur in one document only are gone after the first shuffle. Around the
others, the match is extended: the windows that hold a shared anchor, and only they, are hashed
(128 bits) and the smallest document of each is found. A word goes if a window that covers it has a
smaller document.

Each map task first combines its own rows: of the documents of one batch that share an anchor or a
window, only the smallest meets the other batches, so a passage that a third of all documents hold
costs one row per batch.

Defined results: a null text has no words; a null id neither takes part in matches nor loses words;
rows repeated with the same id are equal and do not remove each other's words (ids are unique but
for such repeats); copies of a whole document lose every word if it has a window, whatever the
order of rows; an empty table gives an empty result; only the two named columns are read, so other
columns may have any name. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm import packed
from verdictflow.session import materialize

WINDOW, PERIOD = 50, 31
#: Residues whose pairwise differences give every residue modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
SECOND = 0xC2B2AE3D27D4EB4F  # multiplier of the second window hash
PACKED = "bucket int, key binary, other binary, doc binary, pos binary, sure_doc binary, sure_pos binary"


def split(text: str) -> list[bytes]:
    """The words: bytes.split() cuts at exactly the blanks x20 and x09 to x0D."""
    return text.encode().split()


def combined(key: np.ndarray, other: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: int, all_sure: bool) -> pa.RecordBatch:
    """Packs the rows of a batch. Rows that another document of this batch already settles go along
    as sure; of each key, the rows of its smallest document stay open."""
    order = np.lexsort((doc, other, key))
    key, other, doc, pos = key[order], other[order], doc[order], pos[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])][:len(key)]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = doc[first], doc[np.r_[first[1:], len(doc)] - 1] if len(doc) else doc
    open_ = doc == least[group]
    sure = (least != most)[group] if all_sure else ~open_
    out = packed.pack(key[open_], n, {"other": other[open_], "doc": doc[open_],
                                      "pos": pos[open_].astype(np.int32)}).to_pydict()
    aside = packed.pack(key[sure], n, {"doc": doc[sure], "pos": pos[sure].astype(np.int32)}).to_pydict()
    extra = dict(zip(aside["bucket"], zip(aside["doc"], aside["pos"], strict=True), strict=True))
    out["sure_doc"] = [extra.get(b, (b"", b""))[0] for b in out["bucket"]]
    out["sure_pos"] = [extra.get(b, (b"", b""))[1] for b in out["bucket"]]
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *[
        (c, pa.binary()) for c in ("key", "other", "doc", "pos", "sure_doc", "sure_pos")]]))


def settle(rows: pd.DataFrame, shared: bool, n: int) -> pd.DataFrame:
    """Of one bucket: the rows whose key has several documents (``shared``), else those whose key has a
    smaller document; packed by document."""
    key, other = packed.unpacked(rows["key"], np.uint64), packed.unpacked(rows["other"], np.uint64)
    doc, pos = packed.unpacked(rows["doc"], np.int64), packed.unpacked(rows["pos"], np.int32)
    order = np.lexsort((doc, other, key))
    key, other, doc, pos = key[order], other[order], doc[order], pos[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])][:len(key)]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    least, most = doc[first], doc[np.r_[first[1:], len(doc)] - 1]
    hit = (least != most)[group] if shared else doc > least[group]
    doc = np.concatenate([doc[hit], packed.unpacked(rows["sure_doc"], np.int64)])
    pos = np.concatenate([pos[hit], packed.unpacked(rows["sure_pos"], np.int32)])
    return packed.pack(doc.view(np.uint64) * np.uint64(packed.SPREAD), n, {"doc": doc, "pos": pos}).to_pandas()


def gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """Positions by document (int32 arrays; at most as many as its words)."""
    ids, found = packed.per_doc(packed.unpacked(rows["doc"], np.int64), packed.unpacked(rows["pos"], np.int32))
    return pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "pos": pd.Series(found, dtype=object)})


def settled(rows: DataFrame, shared: bool, name: str) -> DataFrame:
    """doc_id, pos over all buckets, written once."""
    n = packed.buckets(rows.sparkSession)
    found = rows.groupBy("bucket").applyInPandas(
        lambda pdf: settle(pdf, shared, n), "bucket int, key binary, doc binary, pos binary")
    return materialize(found.groupBy("bucket").applyInPandas(gathered, "doc_id long, pos binary"), name)


def anchors(batches: Iterator[pa.RecordBatch], window: int, period: int, cover: tuple, n: int) -> Iterator[pa.RecordBatch]:
    length = window - period + 1
    for rows in packed.text_batches(batches):
        # equal documents of a batch count once: the others lose all their words anyway
        docs: dict[bytes, tuple[int, list[bytes]]] = {}
        for row in rows:
            words = split(row["text"])
            if len(words) < window:
                continue
            name = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            if name not in docs or row["doc_id"] < docs[name][0]:
                docs[name] = row["doc_id"], words
        if not docs:
            continue
        h, starts = packed.word_hashes([w for _, w in docs.values()])
        key = packed.windows(h, length)
        owner = np.repeat(np.arange(len(docs)), np.diff(starts))
        pos = np.arange(len(h)) - starts[owner]
        use = np.zeros(period, bool)
        use[list(cover)] = True
        at = np.flatnonzero(use[pos % period] & (pos + length <= np.diff(starts)[owner]))
        ids = np.fromiter((d for d, _ in docs.values()), np.int64, len(docs))
        yield combined(key[at], np.zeros(len(at), np.uint64), ids[owner[at]], pos[at], n, True)


def extended(batches: Iterator[pa.RecordBatch], window: int, period: int, n: int) -> Iterator[pa.RecordBatch]:
    """The windows that hold a shared anchor."""
    for rows in packed.text_batches(batches):
        h, starts = packed.word_hashes([split(r["text"]) for r in rows])
        near = np.zeros(len(h) + 1, np.int64)
        for row, a, b in zip(rows, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            at = np.frombuffer(row["pos"], np.int32).astype(np.int64)
            last = b - a - window  # the last window of the document
            low, high = np.maximum(at - (period - 1), 0), np.minimum(at, last) + 1
            low, high = low[low < high], high[low < high]
            np.add.at(near, a + low, 1)
            np.add.at(near, a + high, -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        key, other = packed.windows(h, window), packed.windows(h, window, SECOND)
        owner = np.searchsorted(starts, at, side="right") - 1
        ids = np.fromiter((r["doc_id"] for r in rows), np.int64, len(rows))
        yield combined(key[at], other[at], ids[owner], at - starts[owner], n, False)


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def left_out(row: dict, window: int) -> tuple[int, list[bytes]]:
    """Words removed from a document, and those kept."""
    words = split(row["text"])
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.frombuffer(row["pos"], np.int32)
    at = at[at + window <= len(words)]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def removals(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """doc_id, pos: starts of the windows of each document (doc_id, text) that a smaller one has."""
    n = packed.buckets(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull())
    shared = settled(docs.mapInArrow(lambda b: anchors(b, window, period, cover, n), PACKED), True, "dedup-anchors")
    near = packed.fetch(docs, shared)
    return settled(near.mapInArrow(lambda b: extended(b, window, period, n), PACKED), False, "dedup-windows")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(map(len, words), pa.int64()),
                                              "sha": pa.array(map(sha256, words), pa.string())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packed.text_batches(batches):
            done = [left_out(r, window) for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
                "gone": pa.array([n for n, _ in done], pa.int64()), "kept": pa.array([sha256(w) for _, w in done], pa.string())})

    every = materialize(docs.mapInArrow(profile, "doc_id long, n_words long, sha string"), "dedup-words")
    # a copy of a whole document: the smallest id of equal word sequences has it first
    copies = (every.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("sha")
              .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
              .select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")))
    marked = (every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
              .join(copies, ["sha", "salt"], "left"))
    found = packed.fetch(docs, removals(docs, window, period, cover)).mapInArrow(cut, "doc_id long, gone long, kept string")
    whole = F.col("doc_id") > F.col("first")
    return (marked.join(found.dropDuplicates(["doc_id"]), "doc_id", "left")
            .select("doc_id", "n_words",
                    F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT x.doc_id, unnest(range(p, p + 50)) AS i FROM x JOIN m USING (h) WHERE x.doc_id > m.least),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d SEMI JOIN r USING (doc_id)) e
      JOIN d USING (doc_id) ANTI JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN r.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
