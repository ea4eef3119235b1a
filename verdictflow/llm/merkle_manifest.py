"""Merkle manifest of a table: one tree per group, a root over the groups, a proof for every row.

Leaf coordinates come from ranks, not from a sort. The ids of a group are cut into chunks of 65,536
values. Map tasks pack their rows by chunk, each pack with a compressed bitmap of its ids; the packs
of a chunk are merged by or-ing the bitmaps. A popcount directory (row counts of chunks, added up
through three levels of 16 id bits each) gives the rank at which a chunk begins, and a rank query on
its bitmap the place of each id in it. Rows then go to slot arrays, keyed by group and place divided
by 4,096; a task reduces twelve levels of a slot array at once, and the nodes that remain go to the
next arrays until every group has one node. The groups are the slots of one more tree.

Every two consecutive nodes become their digest (a last lone node becomes its own digest) while more
than one remains. Digests are lower-case hex, and digests are computed over such text.

Defined results: a null value enters a leaf as ``-``, any other as its UTF-8 length, ``:`` and the
value. Null groups form one group, the first. Null ids come first in their group, by leaf digest.
Repeated rows are leaves of their own beside each other (counted before they move, so a row repeated
very often is one row until its slots are filled); different rows of one id stand in the order of
their digests. An empty table gives no rows. Only the named columns are read, so others may have any
name. Texts of any length are hashed whole, in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.operators.sampling import dense_index
from verdictflow.session import materialize

FANOUT = 12  # levels reduced at once: a slot array holds 2 ** FANOUT nodes
SLOTS = 1 << FANOUT
LOW = 0xFFFF  # id bits inside a chunk
SALTS = 32  # a group's row in the table of groups is joined in this many parts
TAMPERED, NO_ID = 1, 2
#: A leaf on the way: id, how many equal rows it stands for, marks, its digest and its digest after tampering.
ENTRY = np.dtype([("id", "<i8"), ("n", "<i8"), ("marks", "u1"), ("leaf", "u1", 32), ("other", "u1", 32)])
RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


# --- bitmaps ---------------------------------------------------------------------------------------

def compress(lows: np.ndarray) -> bytes:
    """A set of 16-bit values: the values themselves while they are few, else 65,536 bits."""
    lows = np.unique(lows).astype("<u2")
    if len(lows) <= 4096:
        return b"v" + lows.tobytes()
    bits = np.zeros(LOW + 1, bool)
    bits[lows] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def merge_into(words: np.ndarray, container: bytes) -> None:
    if container[:1] == b"b":
        words |= np.frombuffer(container, "<u8", offset=1)
    else:
        lows = np.frombuffer(container, "<u2", offset=1)
        np.bitwise_or.at(words, lows >> 6, np.uint64(1) << (lows & 63).astype(np.uint64))


class RankedBitmap:
    """Rank queries on 65,536 bits through a popcount directory of one entry per word."""

    def __init__(self, containers: Sequence[bytes]):
        self.words = np.zeros(1024, np.uint64)
        for c in containers:
            merge_into(self.words, c)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.size = int(ones.sum())

    def rank(self, lows: np.ndarray) -> np.ndarray:
        """How many members are smaller than each value."""
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)

    def container(self) -> bytes:
        return compress(np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")))


# --- packs and chunks ------------------------------------------------------------------------------

def combined(entries: np.ndarray) -> np.ndarray:
    """Equal leaves of one id as one entry; the leaves of an id in the order of their digests."""
    ids, first, index, n = np.unique(entries["id"], return_index=True, return_inverse=True, return_counts=True)
    if len(ids) == len(entries):
        return entries
    again = n[index] > 1
    seen: dict[tuple[int, bytes], list] = {}
    for e in entries[again]:
        key = (int(e["id"]), e["leaf"].tobytes())
        if key in seen:
            seen[key]["n"] += e["n"]
        else:
            seen[key] = e.copy()
    return np.concatenate([entries[~again], np.array([seen[k] for k in sorted(seen)], ENTRY)])


def digests_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x or bytes(32) for x in column.to_pylist()), np.uint8).reshape(-1, 32)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and chunk: a compressed bitmap of the ids and the entries."""
    for batch in batches:
        if not len(batch):
            continue
        entries = np.zeros(len(batch), ENTRY)
        entries["id"], entries["n"] = batch["id"].to_numpy(), 1
        entries["leaf"], entries["other"] = digests_of(batch["leaf"]), digests_of(batch["other"])
        space = batch["space"].to_numpy()
        tampered = batch["other"].is_valid().to_numpy(zero_copy_only=False)
        entries["marks"] = tampered * TAMPERED + (space == 0) * NO_ID
        trees = batch["tree"].dictionary_encode()
        keys = np.stack([trees.indices.to_numpy().astype(np.int64), space.astype(np.int64), entries["id"] >> 16])
        chunks, which = np.unique(keys, axis=1, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(which.ravel()))
        out = []
        for (tree, sp, hi), rows in zip(chunks.T.tolist(), np.split(order, ends[:-1]), strict=True):
            group = combined(entries[rows])
            out.append({"tree": trees.dictionary[tree].as_py(), "space": sp, "hi": hi,
                        "bits": compress(group["id"] & LOW), "entries": group.tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("space", pa.int32()), ("hi", pa.int64()),
                                                         ("bits", pa.binary()), ("entries", pa.binary())]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds a whole chunk or slot array."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def merge_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs of a chunk as one: bitmap, entries and how many rows they stand for."""
    for row in rows_of(batches):
        packs = row.pop("packs")
        entries = combined(np.frombuffer(b"".join(p["entries"] for p in packs), ENTRY))
        row |= {"n": int(entries["n"].sum()), "bits": RankedBitmap([p["bits"] for p in packs]).container(),
                "entries": entries.tobytes()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([
            ("tree", pa.string()), ("space", pa.int32()), ("hi", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()),
            ("entries", pa.binary())]))


def directory(chunks: DataFrame) -> DataFrame:
    """tree, space, hi, base: the rank at which a chunk begins in its tree.

    Counts are added up by the upper 16, 32 and 48 id bits; each running sum covers the at most
    65,536 children of one parent (the topmost: of one tree and space).
    """
    counts = chunks.select("tree", "space", "hi", "n")
    mid = (counts.groupBy("tree", "space", F.shiftright("hi", 16).alias("mid")).agg(F.sum("n").alias("n"))
           .withColumn("top", F.shiftright("mid", 16)))
    top = mid.groupBy("tree", "space", "top").agg(F.sum("n").alias("n"))

    def before(parent: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    top = top.select("tree", "space", "top", before(["tree"], ["space", "top"]).alias("b1"))
    mid = (mid.withColumn("b2", before(["tree", "space", "top"], ["mid"])).join(top, ["tree", "space", "top"])
           .select("tree", "space", "mid", (F.col("b1") + F.col("b2")).alias("b2")))
    low = counts.withColumn("mid", F.shiftright("hi", 16)).withColumn("b3", before(["tree", "space", "mid"], ["hi"]))
    return low.join(mid, ["tree", "space", "mid"]).select("tree", "space", "hi", (F.col("b2") + F.col("b3")).alias("base"))


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a chunk, cut at the slot arrays they fall into."""
    for row in rows_of(batches):
        entries = np.frombuffer(row["entries"], ENTRY)
        lows, base, n = entries["id"] & LOW, row["base"], row["n"]
        bitmap = RankedBitmap([row["bits"]])
        at = bitmap.rank(lows)
        if n == bitmap.size:  # every id once: its rank is its place
            order = np.empty(n, np.int64)
            order[at] = np.arange(n)
        else:  # a rank counts ids; add the further rows of smaller ids, and of this id those before
            weight = np.zeros(bitmap.size, np.int64)
            np.add.at(weight, at, entries["n"])
            inside = np.zeros(len(entries), np.int64)
            for k in np.flatnonzero(np.bincount(at, minlength=bitmap.size) > 1).tolist():
                same = np.flatnonzero(at == k)
                inside[same] = np.cumsum(entries["n"][same]) - entries["n"][same]
            at = (np.cumsum(weight) - weight)[at] + inside
            order = np.argsort(at)
        entries, first = entries[order], base + at[order]
        last = first + entries["n"]
        for block in range(base >> FANOUT, (base + n - 1 >> FANOUT) + 1):
            lo, hi = max(base, block << FANOUT), min(base + n, block + 1 << FANOUT)
            i, j = np.searchsorted(last, lo, "right"), np.searchsorted(first, hi, "left")
            piece = np.repeat(entries[i:j], np.minimum(last[i:j], hi) - np.maximum(first[i:j], lo))
            yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "block": block, "total": row["total"],
                                               "slot": lo & SLOTS - 1, "entries": piece.tobytes()}], PLACED)


PLACED = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("slot", pa.int32()),
                    ("entries", pa.binary())])


# --- trees -----------------------------------------------------------------------------------------

def height(nodes: int) -> int:
    """Levels that a slot array reduces in a tree of so many nodes."""
    return FANOUT if nodes > SLOTS else (nodes - 1).bit_length()


def reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of a slot array, level by level."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(b"".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def steps(levels: list[list[bytes]], slot: int) -> bytes:
    """The way up from a slot: per level a mark (alone, sibling left, sibling right) and the sibling."""
    out = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        out.append(b"a" if other >= len(nodes) else (b"l" if other < slot else b"r") + nodes[other])
        slot >>= 1
    return b"".join(out)


def folded(node: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a node and its way up give, and the digest of the siblings on the way."""
    at, siblings = 0, []
    while at < len(path):
        mark, other = path[at:at + 1], path[at + 1:at + 65]
        if mark == b"a":
            node, at = digest(node), at + 1
            continue
        node, at = digest(other + node if mark == b"l" else node + other), at + 65
        siblings.append(other)
    return node, digest(b"".join(siblings))


def fill_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot array of a block of leaves, and the node it reduces to."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("node", pa.binary()),
                        ("entries", pa.binary())])
    for row in rows_of(batches):
        parts = sorted(row.pop("parts"), key=lambda p: p["slot"])
        row["entries"] = b"".join(p["entries"] for p in parts)
        leaves = np.frombuffer(row["entries"], ENTRY)["leaf"]
        row["node"] = reduced([x.tobytes().hex().encode() for x in leaves], height(row["total"]))[-1][0]
        yield pa.RecordBatch.from_pylist([row], schema)


def fill_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of a slot array of nodes (as ``slot`` null), and the way up from each slot."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("slot", pa.int32()),
                        ("value", pa.binary())])
    for row in rows_of(batches):
        parts = sorted(row.pop("parts"), key=lambda p: p["slot"])
        levels = reduced([p["node"] for p in parts], height(row["total"]))
        out = [row | {"slot": None, "value": levels[-1][0]}]
        out += [row | {"slot": i, "value": steps(levels, i)} for i in range(len(parts))]
        yield pa.RecordBatch.from_pylist(out, schema)


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Reduces nodes (tree, block, total, node), of which no tree has more than ``most``.

    Returns (tree, node) of the roots and (tree, block, path), the way from each node to its root.
    """
    start, rounds = nodes, []
    while most > 1:
        grouped = (nodes.groupBy("tree", F.shiftright("block", FANOUT).alias("up"), "total")
                   .agg(F.collect_list(F.struct(F.col("block").bitwiseAND(SLOTS - 1).cast("int").alias("slot"), "node"))
                        .alias("parts")).withColumnRenamed("up", "block"))
        done = materialize(grouped.mapInArrow(
            fill_slots, "tree string, block long, total long, slot int, value binary"), "merkle-nodes")
        rounds.append(done.filter("slot is not null"))
        nodes = done.filter("slot is null").select("tree", "block", F.ceil(F.col("total") / SLOTS).alias("total"),
                                                   F.col("value").alias("node"))
        most = -(-most // SLOTS)
    paths = None
    for done in reversed(rounds):
        here = done.select("tree", F.col("block").alias("up"),
                           (F.shiftleft("block", FANOUT) + F.col("slot")).alias("block"), F.col("value").alias("path"))
        if paths is None:
            paths = here.select("tree", "block", "path")
        else:
            above = paths.select("tree", F.col("block").alias("up"), F.col("path").alias("rest"))
            paths = here.join(above, ["tree", "up"]).select("tree", "block", F.concat("path", "rest").alias("path"))
    if paths is None:
        paths = start.select("tree", "block", F.lit(b"").alias("path"))
    return nodes.select("tree", "node"), paths


def salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result rows of a block of leaves."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in
                        ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    for row in rows_of(batches):
        entries = np.frombuffer(row["entries"], ENTRY)
        leaves = [x.tobytes().hex().encode() for x in entries["leaf"]]
        levels = reduced(leaves, height(row["total"]))
        rest, root = row["path"] + row["group_path"], row["root"].decode()
        found = [folded(e["other"].tobytes().hex().encode() if e["marks"] & TAMPERED else leaf, steps(levels, i) + rest)
                 for i, (e, leaf) in enumerate(zip(entries, leaves, strict=True))]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(entries["id"], mask=(entries["marks"] & NO_ID) > 0),
            "leaf": [x.decode() for x in leaves], "subroot": [row["subroot"].decode()] * len(leaves),
            "root": [root] * len(leaves), "proof_sha256": [p.decode() for _, p in found],
            "folded_root": [f.decode() for f, _ in found], "verified": [f == row["root"] for f, _ in found]}, schema)


def manifest(rows: DataFrame, group: str, row_id: str, leaf: Column, other: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is the hex digest of a row; ``other``, where not null, the digest that a reader would
    compute from a changed copy of it: ``folded_root`` is the root that follows from it with the
    siblings of the proof, and ``verified`` says whether that is the root.
    """
    other = F.lit(None).cast("string") if other is None else other
    leaves = rows.select(F.col(group).cast("string").alias("g"), F.col(row_id).cast("long").alias("i"), leaf.alias("leaf"),
                         other.alias("other"))
    # rows without an id are ranked by 60 bits of their digest, in a space of ids before the others
    by_leaf = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    packs = leaves.select(framed(F.col("g")).alias("tree"), F.col("i").isNotNull().cast("int").alias("space"),
                          F.coalesce("i", by_leaf).alias("id"), F.unhex("leaf").alias("leaf"), F.unhex("other").alias("other")
                          ).mapInArrow(pack, "tree string, space int, hi long, bits binary, entries binary")
    merged = packs.groupBy("tree", "space", "hi").agg(F.collect_list(F.struct("bits", "entries")).alias("packs"))
    chunks = materialize(merged.mapInArrow(
        merge_chunks, "tree string, space int, hi long, n long, bits binary, entries binary"), "merkle-chunks")
    totals = chunks.groupBy("tree").agg(F.sum("n").alias("total"))
    based = directory(chunks).withColumn("salt", F.pmod(F.xxhash64("space", "hi"), F.lit(SALTS)).cast("int"))
    based = based.join(salted(totals), ["tree", "salt"]).drop("salt")
    placed = chunks.join(based, ["tree", "space", "hi"]).mapInArrow(
        place, "tree string, block long, total long, slot int, entries binary")
    arrays = placed.groupBy("tree", "block", "total").agg(F.collect_list(F.struct("slot", "entries")).alias("parts"))
    blocks = materialize(arrays.mapInArrow(
        fill_blocks, "tree string, block long, total long, node binary, entries binary"), "merkle-blocks")

    size = totals.agg(F.max("total"), F.count(F.lit(1))).first()
    nodes = blocks.select("tree", "block", F.ceil(F.col("total") / SLOTS).alias("total"), "node")
    roots, paths = climb(nodes, -(-(size[0] or 0) // SLOTS))
    name = F.when(F.col("tree") != "-", F.expr("substr(tree, instr(tree, ':') + 1)"))
    groups = dense_index(roots.withColumn("name", name), ["name"], "block")
    groups = materialize(groups.select("tree", "block", "node"), "merkle-groups")
    above = groups.select(F.lit("").alias("tree"), "block", F.lit(size[1]).cast("long").alias("total"), "node")
    root, group_paths = climb(above, size[1])
    group_paths = group_paths.join(root.select("tree", F.col("node").alias("root")), "tree").drop("tree")
    groups = groups.join(group_paths.withColumnRenamed("path", "group_path"), "block").select(
        "tree", F.col("node").alias("subroot"), "group_path", "root")

    out = blocks.drop("node").join(paths, ["tree", "block"]).withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
    return out.join(salted(groups), ["tree", "salt"]).mapInArrow(prove, RESULT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def leaf(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")),
                    F.when(touched, leaf(F.col("n_chars").cast("decimal(38,0)") + 1)))


#: crc32 has no function in DuckDB: it is folded bit by bit over the decimal digits.
OP11_SQL = """
WITH RECURSIVE
parts AS (
  SELECT doc_id, lang, n_chars, hash,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT],
          list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::BIGINT[]),
            lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS hash
        FROM documents)),
leaves AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND hash % 7 = 0 THEN
      sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') || tail) END AS other
  FROM parts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT 0 AS lvl, lang, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, lang, idx // 2, (n + 1) // 2, sha256(h || coalesce(nxt, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS nxt FROM nodes WHERE n > 1) WHERE idx % 2 = 0),
langs AS (
  SELECT lang, lvl AS levels, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS lvl, g AS idx, n, subroot AS h FROM langs
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(nxt, ''))
  FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS nxt FROM above WHERE n > 1) WHERE idx % 2 = 0),
top AS (SELECT h AS root, lvl AS levels FROM above WHERE n = 1),
steps AS (
  SELECT p.lang, p.idx, l.lvl, (p.idx >> l.lvl) & 1 AS odd, s.h AS sibling
  FROM placed p JOIN langs g ON p.lang IS NOT DISTINCT FROM g.lang
  JOIN (SELECT DISTINCT lvl FROM nodes) l ON l.lvl < g.levels
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = l.lvl AND s.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL
  SELECT p.lang, p.idx, g.levels + l.lvl, (g.g >> l.lvl) & 1, s.h
  FROM placed p JOIN langs g ON p.lang IS NOT DISTINCT FROM g.lang
  JOIN (SELECT DISTINCT lvl FROM above) l ON l.lvl < (SELECT levels FROM top)
  LEFT JOIN above s ON s.lvl = l.lvl AND s.idx = xor(g.g >> l.lvl, 1)),
ways AS (
  SELECT lang, idx, list(coalesce(sibling, '') ORDER BY lvl) AS siblings, list(odd ORDER BY lvl) AS odds,
    sha256(string_agg(coalesce(sibling, ''), '' ORDER BY lvl)) AS proof
  FROM steps GROUP BY lang, idx),
folds AS (
  SELECT p.lang, p.idx, 1 AS step, coalesce(p.other, p.leaf) AS cur, w.siblings, w.odds
  FROM placed p LEFT JOIN ways w ON p.lang IS NOT DISTINCT FROM w.lang AND p.idx = w.idx
  UNION ALL
  SELECT lang, idx, step + 1, sha256(CASE WHEN odds[step] = 1 THEN siblings[step] || cur ELSE cur || siblings[step] END),
    siblings, odds
  FROM folds WHERE step <= coalesce(len(siblings), 0))
SELECT p.doc_id, p.leaf, g.subroot, t.root, coalesce(w.proof, sha256('')) AS proof_sha256, f.cur AS folded_root,
  f.cur = t.root AS verified
FROM placed p JOIN langs g ON p.lang IS NOT DISTINCT FROM g.lang
JOIN folds f ON p.lang IS NOT DISTINCT FROM f.lang AND p.idx = f.idx AND f.step = coalesce(len(f.siblings), 0) + 1
LEFT JOIN ways w ON p.lang IS NOT DISTINCT FROM w.lang AND p.idx = w.idx
CROSS JOIN top t
"""
