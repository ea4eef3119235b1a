"""N-gram Jaccard join by PartEnum signatures.

A set is a set of hashed word shingles. The hash range is the feature domain, partitioned into its
single values. Subsets of parts are enumerated such that linked sets share one: a signature is a run
of neighbouring parts that holds exactly two features, so it says that both are there and nothing
between them. A feature that only one of two sets has spoils two runs of its own set and one of the
other. Linked sets are of similar size (the band: each at least 3/4 of the other), which bounds these
features: of a set of x features at most x / 2 runs are not runs of the other set. So if every set
puts its runs in one global order, the first x / 2 + 1 of each are enough to share one. Sets of at
most ``SMALL`` features, and those that such a set can be linked with, use single parts instead.
Fixed ranges as parts would need fewer than three features each on average, and most would hold one;
one shingle is shared by chance far too often.

Features that very many sets have, such as those of a licence text, come last in the global order.
A set with enough other runs never uses runs of two such features. One without has at least half of
its features among them, so a set linked with it has at least 3/16 (it lacks a quarter of the other's
features at most and is larger by a third at most): all such sets put their single features in order
as well, frequent ones last, and share one of the first quarter and one more. Runs of two frequent
features are therefore never emitted. The list of frequent features is a bounded hint: it changes the
number of candidates, never the links.

The place of a signature in a set's order bounds the other set, too. The first one that linked sets
share has none of the other set's signatures before it. At place i of x single features, at most
x - i features are common, so the other set has at most (4x - 7i) / 3. A run at place i has i runs
before it that were spoiled, which leaves the other set at most (5x - 7i) / 2 features. This is the
signature's reach: a pair is a candidate where each size is within the other's reach.

Signatures are matched in packed buckets; those that the same sets have are one group, whose sets
keep their largest reach. In each group, sets are first compared with a hub (a star, linear in its
size; each group picks one of eight orders of hubs); the links found join the sets into components,
and only sets that are then still apart from most of their group are compared with its other
components: in blocks of a group, so that a pair becomes a row only if it passes
an exact lower bound on the difference (parity sketches). Only then are shingles fetched and
compared. Equal sets link by their digest and count once in a group.

Defined results: a null or empty text has no shingles and links with nothing; a text of fewer words
than a shingle is one feature, its whole word sequence; a null id is never linked and has a null
component; rows repeated with the same id are equal (ids are unique but for such repeats) and all
stay; an empty table gives an empty result; only the two named columns are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm import packed
from verdictflow.llm.components import components
from verdictflow.session import materialize

SHINGLE = 5
#: The threshold: links need 100 * intersection >= PERCENT * union.
PERCENT = 75
SMALL = 8  # features up to which sets use single parts
OFTEN, HINTS = 2, 262_144  # sets of a batch that share a frequent feature; bound on the list of them
HUBS = 8  # orders in which groups pick, of members that reach equally far, the one compared with all others first
BLOCK, ROOM = 262_144, 512  # a block of a group holds about so many features, a set counting as ROOM more than it has
MIX = np.uint64(0xD6E8FEB86659FD93)
PROFILE = "doc_id long, n long, digest binary, sketch binary, feature long, sets long"
PACKED = "bucket int, key binary, reach binary, doc binary, size binary, count binary"
SHARED = "token long, doc_id long, size long, reach long, hub long, hub_size long, hub_reach long"
MEMBER = "doc_id", "size", "reach", "component", "sketch"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return (x ^ x >> np.uint64(29)) * MIX


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, words cut at x20 and x09-x0D."""
    docs = [t.encode().lower().split() for t in texts]  # bytes: only A-Z change
    h, starts = packed.word_hashes(docs)
    full = packed.windows(h, size)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a:b - size + 1]))
        elif b > a:
            out.append(packed.windows(h[a:b], b - a)[:1] ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(features: np.ndarray) -> bytes:
    """128 bits of a set."""
    return packed.xxhash.xxh3_128_digest(features.tobytes())


def sketch(features: np.ndarray) -> bytes:
    """Parity of the number of features per bin, in at least twice as many bins as features."""
    bins = max(64, 1 << int(2 * len(features) - 1).bit_length())
    parity = np.bincount((features & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the symmetric difference of two sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def linked(inter: int, a: int, b: int) -> bool:
    return a > 0 and b > 0 and 100 * inter >= PERCENT * (a + b - inter)


def most_difference(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def ranks(doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of each item among those of its document (``doc`` ascending), ``last`` ones at the end."""
    n = int(doc[-1]) + 1 if len(doc) else 0
    first = np.searchsorted(doc, np.arange(n))
    ahead, behind = np.cumsum(~last), np.cumsum(last)
    base = np.r_[0, ahead][first], np.r_[0, behind][first]
    early = np.bincount(doc[~last], minlength=n)
    return np.where(last, early[doc] + behind - base[1][doc], ahead - base[0][doc]) - 1


def signatures(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set numbers) of the signatures of each set (sorted features)."""
    return reaching_signatures(sets, frequent)[:2]


def reaching_signatures(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set numbers, reaches) of the signatures of each set (sorted features)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    hot = np.zeros(len(flat), bool)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat
    # runs of two features; those of two frequent ones come last in the order and are never needed
    run = np.flatnonzero((owner[1:] == owner[:-1]) & (sizes[owner[1:]] > SMALL))
    run = run[~(hot[run] & hot[run + 1])]
    o = owner[run]
    place = ranks(o, np.zeros(len(o), bool))
    use = place <= sizes[o] // 2
    key, o, place = mixed(mixed(flat[run[use]]) + flat[run[use] + 1]), o[use], place[use]
    reach = (5 * sizes[o] - 7 * place) // 2
    # single features, of small sets and of those that much of a set with too few other runs may share
    much = 16 * np.bincount(owner[hot], minlength=len(sets)) >= 3 * sizes
    one = np.flatnonzero(((sizes <= SMALL * 100 // PERCENT) | much)[owner])
    p = owner[one]
    need = sizes - -(-PERCENT * sizes // 100)
    place = ranks(p, hot[one])
    use = place <= need[p]
    return (np.concatenate([key, mixed(flat[one[use]])]), np.concatenate([o, p[use]]),
            np.concatenate([reach, (4 * sizes[p] - 7 * place)[use] // 3]))


def distinct_sets(rows: list[dict]) -> tuple[list[int], list[np.ndarray]]:
    """Smallest id and features of each distinct set of a batch that is not empty."""
    found: dict[bytes, tuple[int, np.ndarray]] = {}
    for row, s in zip(rows, shingle_sets([r["text"] for r in rows]), strict=True):
        if len(s) and row["doc_id"] is not None:
            name = digest(s)
            if name not in found or row["doc_id"] < found[name][0]:
                found[name] = row["doc_id"], s
    return [d for d, _ in found.values()], [s for _, s in found.values()]


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size, digest and sketch; and the features that several sets of a batch have."""
    for rows in packed.text_batches(batches):
        sets = shingle_sets([r["text"] for r in rows])
        names = [digest(s) for s in sets]
        none = [None] * len(rows)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "n": pa.array(map(len, sets), pa.int64()),
            "digest": pa.array(names, pa.binary()), "sketch": pa.array(map(sketch, sets), pa.binary()),
            "feature": pa.array(none, pa.int64()), "sets": pa.array(none, pa.int64())})
        apart = list(dict(zip(names, sets, strict=True)).values())
        f, n = np.unique(np.concatenate(apart), return_counts=True)
        f, n = f[n >= OFTEN].view(np.int64), n[n >= OFTEN]
        none = [None] * len(f)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(none, pa.int64()), "n": pa.array(none, pa.int64()), "digest": pa.array(none, pa.binary()),
            "sketch": pa.array(none, pa.binary()), "feature": pa.array(f, pa.int64()), "sets": pa.array(n, pa.int64())})


def packed_signatures(ids: list[int], sets: list[np.ndarray], frequent: np.ndarray, n: int) -> pa.RecordBatch:
    """The signatures of sets by bucket. Those of a set are neighbours and name it once; the reach is
    rounded up to whole hundredths of the set's size, which fit a byte (a run reaches 5/2 at most)."""
    key, owner, reach = reaching_signatures(sets, frequent)
    at = packed.places(key, n)
    order = np.lexsort((owner, at))
    key, owner, reach, at = key[order], owner[order], reach[order], at[order]
    size = np.array([len(s) for s in sets], np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])][:len(key)])
    each = packed.pack(key, n, {"reach": -(-100 * reach // size[owner]).astype(np.uint8)})
    runs = packed.pack(key[first], n, {"doc": np.array(ids, np.int64)[owner[first]], "size": size[owner[first]].astype(np.int32),
                                       "count": np.diff(np.r_[first, len(key)]).astype(np.int32)})
    return pa.RecordBatch.from_pydict({c: (each if c in each.schema.names else runs).column(c)
                                       for c in ("bucket", "key", "reach", "doc", "size", "count")})


def unpacked_signatures(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, documents, sizes, reaches) of one bucket."""
    count = packed.unpacked(rows["count"], np.int32)
    size = np.repeat(packed.unpacked(rows["size"], np.int32).astype(np.int64), count)
    return (packed.unpacked(rows["key"], np.uint64), np.repeat(packed.unpacked(rows["doc"], np.int64), count), size,
            packed.unpacked(rows["reach"], np.uint8) * size // 100)


def matched(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the groups of documents that share a signature, each with one of them as hub: of
    those that reach furthest, that have least of their own, the first in one of ``HUBS`` orders.
    A group's name depends on its documents only, so the signatures of a group are one."""
    key, doc, size, reach = unpacked_signatures(rows)
    order = np.lexsort((-reach, doc, key))
    order = order[np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])][:len(key)]]
    key, doc, size, reach = key[order], doc[order], size[order], reach[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    count = np.diff(np.r_[first, len(key)])
    several = np.repeat(count > 1, count)
    doc, size, reach, count = doc[several], size[several], reach[several], count[count > 1]
    members = np.add.reduceat(mixed(doc.view(np.uint64) + MIX), np.r_[0, np.cumsum(count)[:-1]]) if len(count) else doc.view(np.uint64)
    name = np.repeat(mixed(members + count.astype(np.uint64)), count)
    order = np.lexsort((-reach, doc, name))
    order = order[np.r_[True, (name[order][1:] != name[order][:-1]) | (doc[order][1:] != doc[order][:-1])][:len(name)]]
    name, doc, size, reach = name[order], doc[order], size[order], reach[order]
    order = np.lexsort((mixed(doc.view(np.uint64) + name % np.uint64(HUBS) * MIX), -reach, name))
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][:len(name)])
    hub = np.repeat(order[first], np.diff(np.r_[first, len(name)]))
    return pd.DataFrame({"token": name.view(np.int64), "doc_id": doc, "size": size, "reach": reach,
                         "hub": doc[hub], "hub_size": size[hub], "hub_reach": reach[hub]})


def shared_signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """token, doc_id, size, reach, hub, hub_size, hub_reach: groups that share signatures, written once."""
    n = packed.buckets(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packed.text_batches(batches):
            yield packed_signatures(*distinct_sets(rows), frequent, n)

    found = docs.mapInArrow(emit, PACKED).groupBy("bucket").applyInPandas(matched, SHARED)
    found = found.groupBy("token", "doc_id").agg(F.max("size").alias("size"), F.max("reach").alias("reach"),
                                                 F.max(F.struct("hub_reach", "hub", "hub_size")).alias("h"))
    return materialize(found.select("token", "doc_id", "size", "reach", "h.*"), "jaccard-signatures")


def frequent_features(rows: DataFrame) -> np.ndarray:
    """The features of most sets, sorted: whole levels of frequency, from the top, up to ``HINTS`` features.

    Levels are counted first, so the driver gets the chosen features only, however many there are.
    """
    counts = materialize(rows.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("sets").alias("sets")),
                         "jaccard-features").withColumn("level", F.floor(8 * F.log2("sets")).cast("int"))
    room, least = HINTS, None
    for level, n in sorted(counts.groupBy("level").agg(F.count(F.lit(1))).collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    if least is None:
        return np.zeros(0, np.uint64)
    found = counts.filter(F.col("level") >= least).select("feature").toArrow().column("feature").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def comparable(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def within(a: str, a_reach: str, b: str, b_reach: str):
    """Whether each size is within the reach of the other's signature."""
    return (F.col(a) <= F.col(b_reach)) & (F.col(b) <= F.col(a_reach))


def near(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    def side(x: str) -> DataFrame:
        return profile.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            ok = [least_difference(s, t) <= most_difference(x, y)
                  for s, t, x, y in zip(col["a_s"], col["b_s"], col["a_n"], col["b_n"], strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(ok)) for c in ("a", "b")})

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(passing, "a long, b long")


def links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold.

    The texts of the pairs move, smaller than their sets are: once by id, and once more with each pair.
    """
    def compared(a: list[str], b: list[str]) -> list[bool]:
        texts = list(dict.fromkeys(a + b))
        sets = dict(zip(texts, shingle_sets(texts), strict=True))
        return [linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]))
                for x, y in zip(a, b, strict=True)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a_t", "b_t"))
            ends = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
            cuts = [*np.unique(ends // packed.BATCH_CHARS, return_index=True)[1].tolist(), len(batch)]
            ok = pa.array([x for at, end in pairwise(cuts) for x in compared(a[at:end], b[at:end])], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(ok) for c in ("a", "b")})

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = packed.suspects(docs, ids).filter("_near").select("doc_id", "text").dropDuplicates(["doc_id"])

    def side(x: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_t"))

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(compare, "a long, b long")


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one per row, words of 64 bits) with bins added up to so many words."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def by_width(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, words) of the sketches of each width."""
    width = np.array([len(x) // 8 for x in sketches], np.int64)
    out = []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out.append((at, np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), w)))
    return out


def close(few: dict, rows: dict, main: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``few``, in ``rows``) of the pairs of two blocks of a group that are in different components
    and that neither sizes nor reaches nor sketches rule out; two sets outside of ``main`` pair once."""
    x, n, reach, part = (few[c][:, None] for c in MEMBER[:4])
    y, m, far, other = (rows[c][None, :] for c in MEMBER[:4])
    may = (part != other) & ((other == main) | (x < y)) & (n <= far) & (m <= reach)
    may &= np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT
    found = [np.zeros((0, 2), np.int64)]
    for i, s in by_width(few["sketch"]):
        for j, t in by_width(rows["sketch"]):
            tried = may[np.ix_(i, j)]
            if tried.any():
                width = min(s.shape[1], t.shape[1])
                a, b = folded(s, width), folded(t, width)
                for k in np.flatnonzero(tried.any(axis=1)).tolist():
                    to = np.flatnonzero(tried[k])
                    least = np.bitwise_count(b[to] ^ a[k]).sum(axis=1, dtype=np.int64)
                    to = j[to[least <= most_difference(few["size"][i[k]], rows["size"][j[to]])]]
                    found.append(np.column_stack([np.full(len(to), i[k]), to]))
    return tuple(np.concatenate(found).T)


def members(column: pa.ListArray) -> Iterator[dict]:
    """The columns of each list of members."""
    flat, ends = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].tolist()
    col = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in MEMBER[:4]} | {"sketch": flat.field("sketch").to_pylist()}
    for a, b in pairwise(ends):
        yield {c: v[a:b] for c, v in col.items()}


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The close pairs (a, b), a < b, of each pair of blocks."""
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for few, rows, main in zip(members(batch.column("few")), members(batch.column("rows")),
                                   batch.column("main").to_pylist(), strict=True):
            i, j = close(few, rows, main)
            a.append(np.minimum(few["doc_id"][i], rows["doc_id"][j]))
            b.append(np.maximum(few["doc_id"][i], rows["doc_id"][j]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def apart(shared: DataFrame, found: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of documents that share a signature but no component, and that their sketches
    do not rule out: those outside the largest component of a group with the group's other components.

    Groups are cut into blocks by id. Most are one block, compared where it is; of the others, each block's
    documents outside the largest component meet every block of the group.
    """
    rows = shared.join(found, "doc_id", "left").select(
        "token", "doc_id", "size", "reach", F.coalesce("component_id", "doc_id").alias("component"))
    groups = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + ROOM).alias("room"))
    main = (groups.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("g"),
                                        F.ceil(F.sum("room") / BLOCK).alias("blocks"))
            .filter("g > 1").select("token", "blocks", F.col("m.component").alias("main")))
    rows = rows.join(main, "token").join(profile.select("doc_id", "sketch"), "doc_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    blocks = rows.groupBy("token", "main", "blocks", "block").agg(F.collect_list(F.struct(*MEMBER)).alias("rows"))
    blocks = materialize(blocks, "jaccard-blocks").withColumn("few", F.filter("rows", lambda r: r.component != F.col("main")))
    several = blocks.filter("blocks > 1")
    few = several.filter(F.size("few") > 0).select("token", "few", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = few.join(several.drop("few"), ["token", "block"]).select("few", "rows", "main")
    return blocks.filter("blocks = 1").select("few", "rows", "main").unionByName(met).mapInArrow(compare_blocks, "a long, b long").distinct()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(docs.mapInArrow(profiles, PROFILE), "jaccard-profiles")
    every = rows.filter("n IS NOT NULL").select("doc_id", "n", "digest", "sketch")
    frequent = frequent_features(rows)
    docs = docs.filter(F.col("doc_id").isNotNull())
    usable = every.filter("doc_id IS NOT NULL AND n > 0")
    one = usable.dropDuplicates(["doc_id"])
    first = (usable.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z")
             .select("digest", "a", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")))
    equal = (usable.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
             .join(first, ["digest", "salt"]).select("a", F.col("doc_id").alias("b")).filter("a < b"))
    equal = materialize(equal, "jaccard-equal")
    # the smallest of equal sets is in every group that one of them is in
    shared = shared_signatures(docs, frequent).join(equal.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
    star = (shared.filter("hub <> doc_id").filter(comparable("hub_size", "size") & within("hub_size", "hub_reach", "size", "reach"))
            .select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
    star = materialize(near(star, one), "jaccard-star")
    known = materialize(equal.union(links(star, docs)), "jaccard-links")
    rest = materialize(apart(shared, components(known), one).join(star, ["a", "b"], "left_anti"), "jaccard-rest")
    found = components(known.union(links(rest, docs)))
    return (every.join(found, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, and every row that is linked with nothing.

    Rows without id are told apart by a hash of their text and come after all others; of rows that are
    equal in id and text one stays. Only rows that may be repeated are moved for that.
    """
    given, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(given, F.xxhash64(text).bitwiseAND((1 << 62) - 1) + (1 << 62))
    rows = df.withColumn("__key", key)
    found = join(rows, "__key", text_col).filter("component_id <> doc_id").select("doc_id").distinct()
    left = packed.without(rows, materialize(found, "jaccard-gone"), "__key")
    again = rows.groupBy(F.col("__key").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    seen = packed.suspects(left, materialize(again, "jaccard-repeated"), "__key")
    once = seen.filter("_near").withColumn("__text", F.md5(text)).dropDuplicates(["__key", "__text"]).drop("__text")
    return seen.filter(~F.col("_near")).unionByName(once).drop("_near", "__key")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(x) AS x FROM (
    SELECT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t USING (x) WHERE s.doc_id < t.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
