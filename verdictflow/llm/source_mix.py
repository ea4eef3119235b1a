"""Mixing sources to target weights, as a curriculum that changes over the training run.

Every source has a weight, and a schedule: how strongly it is drawn at each time t in [0, 1] of the
run. Targets in words follow from the weights; a target stops at ``most`` times the size of its
source and the excess goes to the others by weight. The documents of a source are laid end to end
in a hashed order, once per pass; the words drawn up to time t are the integral of the schedule,
scaled to the target, so the word at place u is drawn at the time where that integral reaches u.
That time is the training position of the document copy, and the training order is a range sort by
position. A copy is taken when its middle word lies below the target: a source misses its target by
at most half a document.

Running sums never pass through one task: a source is cut into 16 ** ``digits`` hash buckets, bucket
totals are summed first, and each bucket sums its own documents.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
last in order; rows with a null id are ordered by a hash of their text; repeated rows are documents
of their own; an empty table gives an empty result; sources without words have target 0; only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, strength) of the sources' schedules, repeating like the weights: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)), ((0.0, 2.0), (0.7, 1.0), (1.0, 0.5)))
WORD = r"[^\x20\x09-\x0D]+"


def drawn_at(part: Column, knots: tuple) -> Column:
    """The time at which a schedule has drawn the share ``part`` of its total: the inverse of the
    integral of a piecewise linear strength."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, a), (t1, b), area in zip(knots, knots[1:], areas, strict=False):
        rest = part * total - before  # words of this stretch: a x + (b - a) x^2 / 2 (t1 - t0)
        x = 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / (t1 - t0) * rest)))
        before += area
        pieces.append((part * total <= before, t0 + x))
    for holds, t in reversed(pieces):
        out = F.when(holds, t).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of rows (source, source_size): adds place (in code point order, null last) and target.

    The windows run over one row per source. Sorted by the weight level at which a source reaches
    its limit, the sources below the common level are those that stop at the limit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy("level", "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    return (sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
            .withColumn("level", F.col("source_size") * most / F.col("weight"))
            .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * share)
            .withColumn("full", F.coalesce(F.sum("source_size").over(
                level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
            .withColumn("open", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("free", (F.col("total") - F.col("full")) / F.col("open"))
            .withColumn("common", F.max(F.when(F.col("level") >= F.col("free"), F.col("free"))).over(
                Window.partitionBy()))
            .withColumn("target", F.when(F.col("level") >= F.col("free"), F.col("weight") * F.col("common"))
                        .otherwise(F.col("source_size") * most))
            .select("source", "source_size", "place", "target"))


def order_key(id_col: str, text_col: str) -> Column:
    """Names a row and gives its place in its source."""
    return F.coalesce(F.md5(F.col(id_col).cast("string")), F.md5(F.col(text_col).cast("string")), F.lit(""))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, most: float = 2.0,
             digits: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted) and
    positions (training position of each copy, ascending); and the key that orders its source."""
    key = order_key(id_col, text_col)
    source = F.col(source_col).cast("string")
    docs = materialize(df.select(
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("name"),  # joins on null sources too
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"), F.substring(key, 1, digits).alias("bucket")), "mix-sizes")
    buckets = docs.groupBy("name", "source", "bucket").agg(F.sum("size").alias("words"))
    target = targets(buckets.groupBy("name", "source").agg(F.sum("words").alias("source_size"))
                     .select("source", "source_size"), weights, share, most)
    target = target.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ahead = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
               .join(target, "name").select("name", "bucket", "ahead", "source_size", "place", "target"))
    within = (Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (docs.join(offsets, ["name", "bucket"])
              .withColumn("middle", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
                          + F.col("size") / 2))
    turn = F.pmod("place", F.lit(len(schedules)))

    def position(u: Column) -> Column:
        out = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            out = F.when(turn == i, drawn_at(u / F.col("target"), knots)).otherwise(out)
        return out

    copies = int(most) + (most > int(most))
    places = [F.col("middle") + F.col("source_size") * k for k in range(copies)]
    positions = F.array_compact(F.array(*[F.when((F.col("size") > 0) & (u < F.col("target")), position(u))
                                          for u in places]))
    return (placed.withColumn("positions", positions)
            .select("doc_id", "size", "source_size", "target",
                    (F.size("positions") * F.col("size")).alias("taken"), "positions", "key"))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per taken copy (doc_id, position, copy), range sorted by position."""
    return (mix.select("doc_id", F.posexplode("positions").alias("copy", "position"))
            .orderBy("position", "doc_id", "copy"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, range sorted by training position. Rows
    repeated with the same id are equal and share out their copies."""
    copies = (plan_mix(df, id_col, text_col, source_col, **plan).groupBy(F.col("key").alias("_key"))
              .agg(F.flatten(F.collect_list("positions")).alias("_p"), F.count(F.lit(1)).alias("_rows"))
              .filter("size(_p) > 0"))
    rows = df.withColumn("_key", order_key(id_col, text_col)).join(copies, "_key")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # the join has sorted them so
    own = F.filter("_p", lambda _, i: F.pmod(i, F.col("_rows")) == F.col("_turn") - 1)
    return (rows.withColumn("_turn", turn).withColumn("_position", F.explode(own))
            .orderBy("_position", "_key").select(*[F.col(f"`{c}`") for c in df.columns]))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, in the order in which documents are first trained on (those never taken come first)."""
    mix = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.orderBy(F.get("positions", F.lit(0)), "doc_id").drop("positions", "key")


OP7_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT name, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY name),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM r),
l AS (SELECT *, source_size * 2.0::DOUBLE / weight AS level FROM w),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(source_size) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          * 2.0::DOUBLE)
        / sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM l),
t AS (SELECT name, source_size, CASE WHEN level >= free
        THEN weight * max(CASE WHEN level >= free THEN free END) OVER () ELSE source_size * 2.0::DOUBLE END AS target
      FROM f),
c AS (SELECT doc_id, size, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY name ORDER BY k, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
      FROM d JOIN t USING (name))
SELECT doc_id, size, source_size, target,
       size * (CAST(middle < target AS BIGINT) + CAST(middle + source_size < target AS BIGINT)) AS taken FROM c
"""
