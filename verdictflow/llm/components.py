"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.session import materialize

MANY = 1_000  # neighbours from which a vertex is joined in place; there are at most edges / MANY such vertices


def with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) the smallest of u and its neighbours.

    Vertices with very many neighbours are few; they are broadcast, and their edges stay where they are.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    large = least.filter(F.col("n") >= MANY).select("u", F.col("m").alias("__m"))
    seen = edges.join(F.broadcast(large), "u", "left")
    rest = seen.filter("__m IS NULL").drop("__m").join(least.filter(F.col("n") < MANY).drop("n"), "u")
    return seen.filter("__m IS NOT NULL").withColumnRenamed("__m", "m").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest id reachable) of every vertex of ``links`` (a, b) that is not
    the smallest of its component.

    Large-star and small-star steps in turn: each hangs the neighbours of a vertex below the smallest
    one, until every component is a star. Every round is written to the shared folder.
    """
    edges = (links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = with_least(materialize(large.filter("u > v").distinct(), "links"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        before = now
