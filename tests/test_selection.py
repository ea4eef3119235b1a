"""Selection of the first rows of an order by threshold (G9, G13), balanced samples in order."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import sampling as S


def rows_of(kind, rng, size):
    makers = {
        "long": lambda: rng.choice([0, 1, -1, 2**63 - 1, -2**63, rng.randrange(-50, 50), rng.randrange(-2**62, 2**62)]),
        "string": lambda: rng.choice(["", "a", "a\0", "ab", "é", "🙂", "prefix of seven " + str(rng.randrange(30)), "z" * rng.randrange(9)]),
        "date": lambda: datetime.date(1900 + rng.randrange(200), 1 + rng.randrange(12), 1),
        "timestamp": lambda: datetime.datetime(1980, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**15)),
        "double": lambda: rng.choice([0.5, -1.0, rng.random()]),
    }
    return [(None if rng.random() < 0.1 else makers[kind](), i, rng.randrange(3)) for i in range(size)]


def order_key(r):
    first = r[0].encode() if isinstance(r[0], str) else r[0]
    return (r[0] is not None, 0 if first is None else first, r[2], r[1])


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp", "double"])
def test_first_rows(spark, kind):
    rng = random.Random(kind)
    data = rows_of(kind, rng, 400)
    df = spark.createDataFrame(data, f"k {kind}, id long, g int")
    want = sorted(data, key=order_key)
    for n in (0, 1, 7, 45, 399, 400, 500):
        assert [tuple(r) for r in S.top_n(df, n, ["k", "g", "id"]).collect()] == want[:n]


def test_narrow_parts(spark, monkeypatch):
    """Several passes: a part is refined until it has few rows."""
    monkeypatch.setattr(S.threshold, "__defaults__", (3,))
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001 * 2**40).alias("k"), "id")
    assert [r.k >> 40 for r in S.top_n(df, 1234, ["k"]).collect()] == sorted(i * 7919 % 3001 for i in range(3000))[:1234]


def test_equal_rows(spark):
    """Rows equal in the whole order: as many as are wanted, not one more."""
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 50 + [(None, "n")] * 4, "k long, t string")
    for n in (0, 3, 4, 6, 9, 10, 30, 59, 70):
        got = S.top_n(df, n, ["k"]).collect()
        assert [r.k for r in got] == ([None] * 4 + [1] * 5 + [2] * 50)[:n]


def test_plan_sorts_chosen_rows_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("claim_id"), "text")
    for chosen in (S.sample_n(docs, 10), S.head_n(docs, 10)):
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" not in plan and "Window" not in plan  # no checkpoint, no numbering
        sort, below = plan.index("Sort"), plan.index("Filter")
        assert sort < below  # the filter is below the sort
    rows = S.sample_n(docs, 25, 3).collect()
    by_hash = sorted(docs.collect(), key=lambda r: (hashlib.md5(f"3:sample:{r.claim_id}".encode()).hexdigest(), r.claim_id))
    assert [r.claim_id for r in rows] == [r.claim_id for r in by_hash[:25]]
    assert [r.claim_id for r in S.head_n(docs, 5).collect()] == sorted(r.claim_id for r in by_hash)[:5]


def test_balanced_sample_order(spark, monkeypatch):
    monkeypatch.setattr(S, "REPEATS", 4)
    pool = spark.createDataFrame([(0, "yes")] + [(i, "no") for i in range(1, 8)], "claim_id long, ground_truth string")
    got = S.balanced_sample(pool, 41, 5).collect()
    assert len(got) == 42 and sum(r.ground_truth == "yes" for r in got) == 21
    assert sorted(r.round for r in got if r.claim_id == 0) == list(range(21))
    assert all(sorted(r.round for r in got if r.claim_id == i)[:3] == [0, 1, 2] for i in range(1, 8))
    assert [r.shuffle_key for r in got] == sorted(
        hashlib.md5(f"5:order:{r.ground_truth}:{r.round}:{r.claim_id}".encode()).hexdigest() for r in got)


def test_shuffled_order(spark):
    df = spark.range(500).select(F.col("id").alias("claim_id"))
    got = [r.claim_id for r in S.shuffled(df, 7).collect()]
    assert got == sorted(range(500), key=lambda i: (hashlib.md5(f"7:shuffle:{i}".encode()).hexdigest(), i)) and got != sorted(got)


def test_draws_from_one_row_are_spread(spark, monkeypatch):
    """A pool of one row per class: no part of the draws has over twice the median."""
    monkeypatch.setattr(S, "DRAWS", 500)
    pool = spark.createDataFrame([(1, "yes"), (2, "no")], "claim_id long, ground_truth string")
    got = S.synthetic_alternating(spark, pool, 20_000)
    assert got.count() == 20_000 and {(r.i % 2, r.claim_id) for r in got.collect()} == {(0, 1), (1, 2)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan
    salts = spark.range(20_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(20)).alias("s")).count().collect()
    sizes = sorted(r["count"] for r in salts)
    assert sizes[-1] <= 2 * sizes[10]


@pytest.mark.parametrize(("every", "blocks"), [(1, 4), (7, 3), (10, 4096)])
def test_running_rates_by_blocks(spark, monkeypatch, every, blocks):
    monkeypatch.setattr(S, "BLOCKS", blocks)
    rng = random.Random(every)
    flags = [(i, rng.random() < 0.4, rng.choice([True, False, None])) for i in range(200)]
    df = spark.createDataFrame(flags, "claim_id long, escalated boolean, correct boolean")
    got = {r.i: (r.claim_id, r.escalation_rate, r.accuracy) for r in S.running_rates(df, every=every).collect()}
    assert got == {i: (i, sum(e for _, e, _ in flags[:i + 1]) / (i + 1), sum(bool(c) for *_, c in flags[:i + 1]) / (i + 1))
                   for i in range(every, 200, every)}
    assert S.running_rates(df.limit(0)).count() == 0
