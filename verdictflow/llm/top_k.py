"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are quantised to integers, so scores are exact. Candidates are spread over shards by a hash
of their id. Each shard task builds a KD-tree: median splits on the widest dimension, every node
with the tight bounding box of its points. For a query, a box bounds the score of all its points
from above (each component takes the box edge of its own sign); subtrees whose bound is below the
query's kth score so far are dropped level by level, the leaves that remain are visited best bound
first, and the kth score rises on the way. It is also propagated between shards: a first pass
searches every query in its home shard only, and all other shards start from the kth score found.

Queries meet every shard, in parts of at most ``part_rows`` queries, so no task holds more than one
shard and one part.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do
rows with a null id; vectors of different lengths are never compared; a query row that is repeated is
one query, a repeated candidate row counts each time; ties go to the smaller id; queries with fewer
than k candidates return all; an empty table gives an empty result; only the two named columns are
read, so other columns may have any name. Scores are compared as whole numbers of up to 38 digits and
cut to the range of a long in the result only, after ranking.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.session import materialize

LEAF = 64
EXACT = 2 ** 53  # integers below this are exact in float64
WIDE = 10 ** 38 - 1  # scores travel as decimals of 38 digits
HITS = "query_id long, twin long, vec_id long, score decimal(38,0)"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component) of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (df.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")))


class KdTree:
    """Nodes of a shard's tree in breadth-first arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        rows, self.kids, self.rows, low, high = [np.arange(len(points))], [], [], [], []
        for at in rows:  # grows while it is read
            box = points[at]
            low.append(box.min(0))
            high.append(box.max(0))
            width = high[-1] - low[-1]
            if len(at) > leaf and width.size and width.max() > 0:
                half = len(at) // 2
                order = at[np.argpartition(box[:, int(width.argmax())], half)]
                self.kids.append((len(rows), len(rows) + 1))
                self.rows.append(None)
                rows += [order[:half], order[half:]]
            else:
                self.kids.append(None)
                self.rows.append(at)
        self.low, self.high = np.array(low), np.array(high)


def size_of(a: np.ndarray) -> int:
    """The largest magnitude, also where a long has no opposite."""
    return max(int(a.max()), -int(a.min())) if a.size else 0


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over integers: by float64 where that is exact, else in Python integers. Never floats, whose sum with
    a large integer would be rounded."""
    if size_of(a) * size_of(b) * a.shape[1] >= EXACT:
        return a.astype(object) @ b.T.astype(object)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def search(tree: KdTree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray,
           least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and ids per query, best first; places that stay empty have score -inf.

    ``least``: a score known to be reached by k candidates elsewhere (-inf: none).
    """
    n = len(queries)
    # scores are kept as Python integers where one of them might not be exact in float64
    kind = object if size_of(points) * size_of(queries) * points.shape[1] >= EXACT else float
    best, name = np.full((n, k), -np.inf, kind), np.full((n, k), 2 ** 63 - 1)
    kth = least.astype(kind)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)

    def bound(rows: np.ndarray, node: int) -> np.ndarray:
        return (exact_dot(up[rows], tree.high[node:node + 1]) + exact_dot(down[rows], tree.low[node:node + 1]))[:, 0]

    # down the tree: (node, queries that still need it)
    front, leaves = [(0, np.arange(n))], []
    while front:
        below = []
        for node, rows in front:
            b = bound(rows, node)
            open_ = b >= kth[rows]
            rows, b = rows[open_], b[open_]
            if not len(rows):
                continue
            if tree.kids[node] is None:
                leaves.append((node, rows, b))
            else:
                below += [(c, rows) for c in tree.kids[node]]
        front = below
    if not leaves:
        return best, name
    # best bound first: in each round every query visits its next leaf
    query = np.concatenate([r for _, r, _ in leaves])
    node = np.concatenate([np.full(len(r), i) for i, r, _ in leaves])
    score = np.concatenate([b for _, _, b in leaves])
    order = np.lexsort((node, -score.astype(float), query))
    query, node, score = query[order], node[order], score[order]
    turn = np.arange(len(query)) - np.searchsorted(query, query)
    by = np.argsort(turn, kind="stable")
    for r in np.split(by, np.flatnonzero(np.diff(turn[by])) + 1):
        r = r[score[r] >= kth[query[r]]]
        r = r[np.argsort(node[r], kind="stable")]
        for visit in np.split(r, np.flatnonzero(np.diff(node[r])) + 1):
            if not len(visit):
                continue
            q, at = query[visit], tree.rows[node[visit[0]]]
            got = exact_dot(queries[q], points[at])
            got = np.where(ids[at][None, :] == own[q][:, None], -np.inf, got)
            some = (got >= kth[q][:, None]).any(1)
            q, got = q[some], got[some]
            if not len(q):
                continue
            every = np.concatenate([best[q], got], axis=1)
            names = np.concatenate([name[q], np.broadcast_to(ids[at], got.shape)], axis=1)
            if kind is float:
                pick = np.lexsort((names, -every), axis=-1)[:, :k]
            else:
                pick = np.array([sorted(range(len(e)), key=lambda i: (-e[i], m[i]))[:k]
                                 for e, m in zip(every.tolist(), names.tolist(), strict=True)])
            best[q], name[q] = np.take_along_axis(every, pick, 1), np.take_along_axis(names, pick, 1)
            kth[q] = np.maximum(kth[q], best[q][:, k - 1])
    return best, name


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256, shard_rows: int = 4096,
          part_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every query, its own id left out."""
    cand = quantised(candidates, id_col, vector_col, scale)
    ask = quantised(queries, id_col, vector_col, scale).distinct()
    shards = max(1, -(-cand.count() // shard_rows))
    parts = max(1, -(-ask.count() // part_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    cand = cand.withColumn("shard", home).withColumn("dim", F.size("v"))
    ask = (ask.withColumn("home", home).withColumn("dim", F.size("v")).withColumn("twin", F.xxhash64("v"))
           .withColumn("part", F.pmod(F.xxhash64("vec_id", "twin"), F.lit(parts)).cast("int")))

    def look(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "twin", "vec_id", "score")})
        if here.empty or asked.empty:
            return none
        points, q = np.array(here["v"].tolist(), np.int64), np.array(asked["v"].tolist(), np.int64)
        ids, own = here["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        least = np.array([-np.inf if pd.isna(v) else int(v) for v in asked["kth"]], object)
        best, name = search(KdTree(points), points, ids, q, own, least, k)
        row, col = np.nonzero(best != -np.inf)
        score = [Decimal(max(-WIDE, min(WIDE, int(x)))) for x in best[row, col]]
        return pd.DataFrame({"query_id": own[row], "twin": asked["twin"].to_numpy()[row], "vec_id": name[row, col],
                             "score": pd.Series(score, dtype=object)})

    def passed(asked: DataFrame) -> DataFrame:
        spread = cand.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["shard", "part", "dim"]
        return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(look, HITS)

    first = materialize(passed(ask.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("decimal(38,0)"))),
                        "topk-home")
    # a home shard with fewer than k candidates gives no bound
    known = first.groupBy(F.col("query_id").alias("vec_id"), "twin").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    away = (ask.join(known, ["vec_id", "twin"], "left")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home"))
    hits = first.unionByName(passed(away)) if shards > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return (hits.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id",
                    F.greatest(F.least("score", F.lit(2 ** 63 - 1)), F.lit(-2 ** 63)).cast("long").alias("score")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP5_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
