"""Ordering, sampling and positions.

``dense_index`` gives every row its exact 0-based position in a total order
without a global window (which would run in one task): range-partition and
sort, number rows inside each partition, then add the row counts of the
preceding partitions. The per-partition table has one row per partition, so
broadcasting it is bounded by the partition count, not by the data. The
sorted data is checkpointed to the shared checkpoint folder first, so both
uses of it see the same partitioning, and a lost executor re-reads it.
Where only the first rows of an order are wanted, ``top_n`` finds the place of
the last of them by histograms and filters; the rest is never sorted.

Random choices of the reference (``random.sample``, ``shuffle``) become orders
by ``md5(seed:...:key)``: reproducible, the same in every engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.session import ensure_checkpoint_dir, materialize

BLOCKS = 4096        # blocks of rows that one window group sums up
REPEATS = 1024       # copies of a pool row that one task makes
DRAWS = 20_000       # slots that one part of a pool row is joined with, about
_LOCAL_BITS = 33     # monotonically_increasing_id = partition_index << 33 | row_in_partition


def hash_key(seed: int, key: str, *parts: str) -> Column:
    """``md5('seed:part..:key')`` - the reproducible random order used everywhere."""
    pieces = [F.lit(str(seed))] + [F.lit(p) for p in parts] + [F.col(key).cast("string")]
    return F.md5(F.concat_ws(":", *pieces))


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "pos", partitions: int | None = None,
                sums: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name`` = exact 0-based position of each row in ``order`` (must be a total order).

    ``sums`` adds running totals ``{name: per-row value}`` (inclusive of the row).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = s.withColumn("__rid", F.monotonically_increasing_id())
    for k, v in (sums or {}).items():
        s = s.withColumn(f"__v_{k}", v)
    s = s.checkpoint(eager=True)
    pid = F.shiftright(F.col("__rid"), _LOCAL_BITS)
    local = F.col("__rid") - F.shiftleft(pid, _LOCAL_BITS)
    s = s.withColumn("__pid", pid).withColumn("__local", local)
    stats = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                   *[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in (sums or {})])
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = stats.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"),
                        *[F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0)).alias(f"__o_{k}") for k in (sums or {})])
    out = s.join(F.broadcast(offs), "__pid").withColumn(name, F.col("__off") + F.col("__local"))
    if sums:
        wp = Window.partitionBy("__pid").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
        for k in sums:
            out = out.withColumn(k, F.col(f"__o_{k}") + F.sum(f"__v_{k}").over(wp))
    drop = ["__rid", "__pid", "__local", "__off"] + [f"__v_{k}" for k in (sums or {})] + \
        [f"__o_{k}" for k in (sums or {})]
    return out.drop(*drop)


def image(df: DataFrame, first: Column) -> tuple[Column, int, int] | None:
    """A long that never falls as ``first`` rises, with bounds of it; None where the type has none."""
    kind = df.select(first.alias("k")).schema["k"].dataType
    if isinstance(kind, T.StringType):  # the first seven bytes, as a number
        head = F.rpad(F.hex(F.substring(F.encode(first, "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("long"), 0, (1 << 56) - 1
    if isinstance(kind, T.IntegralType | T.DateType | T.TimestampType):
        value = F.unix_micros(first) if isinstance(kind, T.TimestampType) else \
            F.unix_date(first).cast("long") if isinstance(kind, T.DateType) else first.cast("long")
        low, high = df.agg(F.min(value), F.max(value)).first()
        return value, low or 0, high or 0
    return None


def threshold(df: DataFrame, n: int, value: Column, low: int, high: int,
              enough: int = 1 << 16) -> tuple[int | None, int, int] | None:
    """(low, high, before): the bounds of the smallest interval found that holds the ``n``-th smallest value, and
    how many values (and NULLs) lie below it; ``low`` None means that it is among the NULLs. None: there are
    fewer than ``n`` rows.

    Each pass counts values by equal parts of the interval, at most 65,537 rows whatever the data, and
    goes on with the part that holds the value, until that has at most ``enough`` rows or one value.
    """
    before = 0
    while True:
        width = (high - low >> 16) + 1
        from_low = value.cast("decimal(38,0)") - F.lit(low)
        part = ((from_low - from_low % F.lit(width)) / F.lit(width)).cast("long")  # a whole quotient: no rounding
        inside = df.filter(value.isNull() | value.between(low, high)) if before == 0 else df.filter(value.between(low, high))
        counts = {r[0]: r[1] for r in inside.groupBy(part.alias("p")).count().collect()}
        nulls = counts.pop(None, 0)
        if nulls >= n - before and nulls:
            return None, low, before
        before += nulls
        for p in sorted(counts):
            if before + counts[p] >= n:
                low, high, rows = low + p * width, min(high, low + (p + 1) * width - 1), counts[p]
                break
            before += counts[p]
        else:
            return None
        if rows <= enough or low == high:
            return low, high, before


def top_n(df: DataFrame, n: int, order: Sequence[str | Column], probe: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows of an order (NULLs first), sorted by it; among rows equal in it, any.

    No row that is not chosen is sorted or written. A histogram of the first column finds an interval
    that holds the ``n``-th row, the rows in that interval (few, unless they are equal in the column)
    give that row's place in the whole order, and the result is a filter. Sorted are the chosen rows.
    ``probe``: the same rows with the columns of the order only, where these can be read more cheaply.
    """
    probe = df if probe is None else probe
    if n < 0:
        raise ValueError("n must be >= 0")
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if n == 0:
        return df.limit(0)
    found = image(probe, order[0])
    if found is None:
        return df.orderBy(*order).limit(n)
    value, low, high = found
    interval = threshold(probe, n, value, low, high)
    if interval is None:
        return df.orderBy(*order)
    low, high, before = interval
    edge = value.isNull() if low is None else value.between(low, high)
    below = F.lit(False) if low is None else value.isNull() | (value < low)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    last = probe.filter(edge).select(key.alias("k")).orderBy("k").limit(n - before)
    stop = last.agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).select("k.*", "n").first()
    kinds = probe.select(key.alias("k")).schema["k"].dataType
    at = F.struct(*[F.lit(stop[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields])
    equal = df.filter(edge & (key == at))
    less, same = probe.filter(edge).agg(F.count_if(key < at), F.count_if(key == at)).first()
    if less + same <= n - before:
        return df.filter(below | (edge & (key <= at))).orderBy(*order)
    return df.filter(below | (edge & (key < at))).unionByName(equal.limit(n - before - less)).orderBy(*order)


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "claim_id") -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer)."""
    return top_n(df.withColumn("__h", hash_key(seed, key, "sample")), n, ["__h", key]).drop("__h")


def shuffled(df: DataFrame, seed: int = 0, key: str = "claim_id") -> DataFrame:
    """All rows in a reproducible random order (a distributed range sort)."""
    return df.withColumn("__h", hash_key(seed, key, "shuffle")).orderBy("__h", key).drop("__h")


def head_n(df: DataFrame, n: int, key: str = "claim_id") -> DataFrame:
    """The first ``n`` rows by key."""
    return top_n(df, n, [key])


def balanced_sample(df: DataFrame, size: int = 20, seed: int = 0, truth_col: str = "ground_truth",
                    key: str = "claim_id", classes: tuple[str, str] = ("yes", "no")) -> DataFrame:
    """``size`` rounded up to even; half per class; a class smaller than half is
    repeated whole (each repeat a fresh permutation) and the last repeat is cut to fit.

    Rows carry ``round`` (which repeat) and ``shuffle_key`` (the final random order, in which they come).
    Only the two class counts reach the driver.
    """
    size = size if size % 2 == 0 else size + 1
    half = size // 2
    # classes and keys are looked at several times: written once, without the other columns
    keys = materialize(df.filter(F.col(truth_col).isin(*classes)).select(truth_col, key), "balanced-keys")
    counts = {r[0]: r[1] for r in keys.groupBy(truth_col).count().collect()}
    parts = []
    for c in classes:
        pool = counts.get(c, 0)
        if half == 0:
            continue
        if pool == 0:
            raise ValueError(f"no '{c}' rows to sample from")
        rounds = math.ceil(half / pool)
        last_quota = half - (rounds - 1) * pool
        members = df.filter(F.col(truth_col) == c)
        if rounds > 1:  # full repeats: every pool row once per repeat
            # by blocks, which are dealt out before they are filled: a pool of a few rows gives no task all repeats
            blocks = members.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit((rounds - 2) // REPEATS))))
            if rounds - 1 > REPEATS:
                blocks = blocks.repartition(F.col(key), F.col("__b"))
            until = F.least(F.lit(rounds - 2), (F.col("__b") + 1) * REPEATS - 1)
            parts.append(blocks.withColumn("round", F.explode(F.sequence(F.col("__b") * REPEATS, until))).drop("__b"))
        h = hash_key(seed, key, "balanced", c, str(rounds - 1))
        last, probe = members.withColumn("__h", h), keys.filter(F.col(truth_col) == c).withColumn("__h", h)
        parts.append(top_n(last, last_quota, ["__h", key], probe).drop("__h").withColumn("round", F.lit(rounds - 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(truth_col), F.col("round").cast("string"),
                                F.col(key).cast("string")))
    return out.withColumn("shuffle_key", shuffle).orderBy("shuffle_key", key, "round")


def synthetic_alternating(spark, pool: DataFrame, size: int, seed: int = 0, truth_col: str = "ground_truth",
                          key: str = "claim_id") -> DataFrame:
    """``size`` rows; even positions draw (with replacement) from the 'yes' pool, odd from 'no'.

    Pools are numbered by ``dense_index`` per class; the draw is ``md5(seed:i) mod pool size``
    followed by an equi-join on (class, number) - no collect, no cross join.
    """
    counts = {r[0]: r[1] for r in pool.filter(F.col(truth_col).isin("yes", "no")).groupBy(truth_col).count().collect()}
    if not counts.get("yes") or not counts.get("no"):
        raise ValueError("both a 'yes' and a 'no' pool are needed")
    numbered = dense_index(pool.filter(F.col(truth_col).isin("yes", "no")), [truth_col, key], "__g")
    # position inside the class = global position minus the rows of earlier classes ("no" sorts first)
    numbered = numbered.withColumn("__idx", F.when(F.col(truth_col) == "no", F.col("__g"))
                                   .otherwise(F.col("__g") - F.lit(counts["no"])))
    slots = spark.range(size).select(F.col("id").alias("i"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("synthetic"), F.col("i").cast("string"))),
                              1, 12), 16, 10).cast("long")
    slots = slots.withColumn(truth_col, F.when(F.col("i") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")))
    slots = slots.withColumn("__idx", draw % F.when(F.col(truth_col) == "yes", F.lit(counts["yes"]))
                             .otherwise(F.lit(counts["no"])))
    # a small pool is drawn from by very many slots: its rows are copied to as many parts of the slots as
    # that takes for a part of a row to have about DRAWS of them
    parts = max(1, math.ceil(size / 2 / min(counts.values()) / DRAWS))
    pool_side = numbered.drop("__g").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    slots = slots.withColumn("__salt", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    return slots.join(pool_side, [truth_col, "__idx", "__salt"]).drop("__idx", "__salt")


def running_rates(results: DataFrame, order: Sequence[str] = ("claim_id",), every: int = 10) -> DataFrame:
    """Running escalation rate and accuracy at rows i > 0 with i % every == 0 (0-based)."""
    # only the order key and the two flags are positioned (and checkpointed), not the whole result rows
    # written first: range partitioning samples its input, and models must not be asked twice
    slim = materialize(results.select(*order, "escalated", "correct"), "running-rates")
    idx = dense_index(slim, list(order), "i").select(
        "i", *order, F.col("escalated").cast("long").alias("__esc"),
        F.coalesce(F.col("correct"), F.lit(False)).cast("long").alias("__ok"))
    # what is reported is the first row of a block of ``every`` rows and the sums of all earlier blocks: the
    # sorted rows are summed by block where they are, and only the blocks move
    first = F.min_by(F.struct(*order, "__esc", "__ok"), "i").alias("__first")
    blocks = (idx.groupBy(F.expr(f"i div {int(every)}").alias("__b"))
              .agg(first, F.sum("__esc").alias("__e"), F.sum("__ok").alias("__c")).withColumn("__s", F.expr(f"__b div {BLOCKS}")))

    def earlier(c: str, window: Window) -> Column:
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = blocks.groupBy("__s").agg(F.sum("__e").alias("__e"), F.sum("__c").alias("__c"))
    before = Window.orderBy("__s")  # one row per every * BLOCKS rows
    groups = groups.select("__s", earlier("__e", before).alias("__ge"), earlier("__c", before).alias("__gc"))
    inside = Window.partitionBy("__s").orderBy("__b")
    out = blocks.select("__b", "__s", "__first", earlier("__e", inside).alias("__pe"), earlier("__c", inside).alias("__pc"))
    out = out.join(groups, "__s").filter("__b > 0").withColumn("i", F.col("__b") * every)
    done = F.col("i") + 1
    return out.select("i", *[F.col(f"__first.{c}").alias(c) for c in order],
                      ((F.col("__ge") + F.col("__pe") + F.col("__first.__esc")) / done).alias("escalation_rate"),
                      ((F.col("__gc") + F.col("__pc") + F.col("__first.__ok")) / done).alias("accuracy"))
