"""Stored answers and the cascade over them (D1, D4, D12), the call window (D14), the gate's relation."""

import threading
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdictflow.operators.answers import AnswerStore, StoredCascade, digest_of, perhaps_among
from verdictflow.operators.cascade import cascade
from verdictflow.operators.clients import RuleClient
from verdictflow.operators.verifiers import (CallWindow, ModelVerifier, RuleVerifier, TableVerifier, constant_verifier,
                                             join_answers, raw_answer)


def table(spark, tmp_path, n=60):
    """Claims as a Parquet table: lengths alternate, three languages, every claim twice under other ids."""
    rows = [(i, "z" * (i % n + 1), ["en", "de", None][i % 3], "yes") for i in range(2 * n)]
    path = str(tmp_path / "claims.parquet")
    spark.createDataFrame(rows, "claim_id long, claim string, lang string, ground_truth string").write.parquet(path)
    return spark.read.parquet(path)


def asked(log):
    try:
        return Counter(open(log).read().splitlines())
    except FileNotFoundError:
        return Counter()


def roles(tmp_path):
    logs = {r: str(tmp_path / f"{r}.log") for r in ("a", "b", "judge")}
    made = {r: ModelVerifier(lambda path=p: RuleClient(log_path=path), name=f"m_{r}") for r, p in logs.items()}
    made["b"] = RuleVerifier(lambda c: raw_answer("yes", "0.9"), name="rule_b")
    return made, logs


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_second_run_asks_about_new_claims_only(spark, tmp_path):
    claims = table(spark, tmp_path)
    made, logs = roles(tmp_path)
    store = AnswerStore(spark, str(tmp_path / "answers"))
    most = claims.filter(F.length("claim") <= 54)
    first = StoredCascade(most, *made.values(), store).results().collect()
    assert sum(asked(logs["a"]).values()) == 54 and set(asked(logs["a"]).values()) == {1}  # copies are asked about once
    whole = {r.claim_id: r for r in StoredCascade(claims, *made.values(), store).results().collect()}
    assert len(whole) == 120 and sum(asked(logs["a"]).values()) == 60 and set(asked(logs["a"]).values()) == {1}
    assert set(map(len, asked(logs["judge"]))) == set(range(1, 61, 2)) and set(asked(logs["judge"]).values()) == {1}
    assert all(whole[r.claim_id] == r for r in first)
    direct = cascade(claims, constant_verifier("x"), made["b"], constant_verifier("x")).columns
    assert list(whole[0].asDict()) == direct
    want = {r.claim_id: (r.final_verdict, r.escalated, r.judge and r.judge.verdict)
            for r in cascade(claims, ModelVerifier(RuleClient), made["b"], ModelVerifier(RuleClient)).collect()}
    assert {i: (r.final_verdict, r.escalated, r.judge and r.judge.verdict) for i, r in whole.items()} == want


def test_filtered_claims_only(spark, tmp_path):
    claims = table(spark, tmp_path)
    made, logs = roles(tmp_path)
    store = AnswerStore(spark, str(tmp_path / "answers"))
    runs = StoredCascade(claims, *made.values(), store).where("lang = 'de'")
    gate = runs.gate()
    assert not asked(logs["judge"]) and "judge" not in gate.columns
    assert gate.filter("escalated").count() == 20
    results = runs.results()
    german = {r.claim for r in claims.filter("lang = 'de'").collect()}
    assert set(asked(logs["a"])) == german and set(asked(logs["judge"])) == {c for c in german if len(c) % 2}
    _, physical = plan_of(results)
    assert "EqualTo(lang,de)" in physical and "CollectMetrics" not in physical
    # a later filter reaches the scan too, and the gate reads no answers of the judge
    start = time.perf_counter()
    _, physical = plan_of(gate.filter("claim_id > 77 AND escalated").select("claim_id", "escalated"))
    assert time.perf_counter() - start < 2
    assert "GreaterThan(claim_id,77)" in physical and "= a)" in physical and "= judge)" not in physical


def test_gate_is_no_barrier(spark, tmp_path):
    """cascade(): filters on claim columns reach the scan, filters on decisions plan quickly, an unread judge is not asked."""
    claims = table(spark, tmp_path)
    log = str(tmp_path / "judge.log")
    rule = RuleVerifier(lambda c: raw_answer(F.when(F.length(c) % 2 == 0, "yes").otherwise("no"), "0.9"))
    r = cascade(claims, rule, constant_verifier("yes", "0.9"), ModelVerifier(lambda: RuleClient(log_path=log)))
    assert r.filter("escalated").select("claim_id").count() == 60 and r.groupBy("reason").count().count() == 2
    assert not asked(log)
    quick = cascade(claims, rule, constant_verifier("yes", "0.9"), rule)
    start = time.perf_counter()
    _, physical = plan_of(quick.filter("lang = 'en' AND escalated AND judge.error IS NULL AND final_verdict = 'no' AND correct IS NOT NULL"))
    assert time.perf_counter() - start < 2
    assert "EqualTo(lang,en)" in physical and "CollectMetrics" not in physical


def test_errors_are_asked_again(spark, tmp_path):
    claims = spark.createDataFrame([(1, "fine"), (2, "bad!"), (3, None), (4, "fine")], "claim_id long, claim string")
    log, store = str(tmp_path / "a.log"), AnswerStore(spark, str(tmp_path / "answers"))
    assert store.rows().count() == 0
    store.ask(claims, "a", ModelVerifier(lambda: RuleClient(fail_on="bad", log_path=log), name="m", retries=0))
    assert store.rows("a", "m").filter("error IS NOT NULL").count() == 1
    store.ask(claims, "a", ModelVerifier(lambda: RuleClient(log_path=log), name="m"))
    assert asked(log) == {"fine": 1, "bad!": 1}
    got = {r.claim_id: r.a for r in store.verifier("a", ModelVerifier(RuleClient, name="m")).answers(claims, "a", F.col("claim")).collect()}
    assert [got[i].verdict for i in (1, 2, 4)] == ["yes"] * 3 and got[2].error is None and got[3].error == "missing answer"
    packed = store.compact(str(tmp_path / "compact"))
    assert packed.rows().count() == 2 and {r.digest for r in packed.rows().collect()} == {
        r[0] for r in claims.filter("claim IS NOT NULL").select(digest_of(F.col("claim"))).distinct().collect()}


def test_prefixes_are_part_of_the_content(spark, tmp_path):
    claims = spark.createDataFrame([(1, "abc")], "claim_id long, claim string")
    log, store = str(tmp_path / "a.log"), AnswerStore(spark, str(tmp_path / "answers"))
    model = ModelVerifier(lambda: RuleClient(log_path=log), name="m")
    for v in (model, model.with_prefix("Well: "), model.with_prefix("Hm: ").with_prefix("So: ")):
        store.ask(claims, "a", v)
        assert store.verifier("a", v).answers(claims, "a", F.col("claim")).first().a.verdict is not None
    assert asked(log) == {"abc": 1, "Well: abc": 1, "Hm: So: abc": 1}
    assert store.rows().count() == 3


REPEATED = [(0, "a", "yes", "0.9", None), (0, "a", "no", "0.2", None), (0, "b", "yes", "0.8", "boom"), (0, "b", "yes", "0.7", None),
            (1, "a", None, None, "boom")]


def test_repeated_answers(spark):
    """A claim with several stored answers gives one row: no error first, then the smallest answer."""
    claims = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c2")], "claim_id long, claim string")
    out = spark.createDataFrame(REPEATED, "claim_id long, role string, verdict string, confidence string, error string")
    a, b = (TableVerifier(out.filter(F.col("role") == r)) for r in "ab")
    rows = {r.claim_id: r for r in cascade(claims, a, b, constant_verifier("yes")).collect()}
    assert len(rows) == 3 and cascade(claims, a, b, constant_verifier("yes")).count() == 3
    assert rows[0].a.verdict == "no" and rows[0].b.confidence == 0.7 and rows[1].a.error == "boom"
    assert rows[2].a.error == "missing answer"
    joined, (ja, jb, _) = join_answers(claims, out)
    again = {r.claim_id: r for r in cascade(joined, ja, jb, constant_verifier("yes")).collect()}
    assert {i: (r.a, r.b) for i, r in rows.items()} == {i: (r.a, r.b) for i, r in again.items()}
    strict = TableVerifier(out.filter("role = 'a'"), repeated="fail")
    with pytest.raises(Exception, match="several stored answers for 0"):
        strict.answers(claims, "a", F.col("claim")).select("a").collect()
    assert TableVerifier(out.filter("claim_id = 1"), repeated="fail").answers(claims, "a", F.col("claim")).count() == 3


# ----------------------------------------------------------------- D14
class Client:
    """Answers at once, but hangs on "hang" and fails on "fail"; notes calls and how many ran at once."""

    def __init__(self, calls, lock):
        self.calls, self.lock = calls, lock

    def __call__(self, claims):
        with self.lock:
            self.calls.append(list(claims))
        if any("hang" in c for c in claims):
            time.sleep(5)
        if any("fail" in c for c in claims):
            raise RuntimeError("down")
        return pd.DataFrame({"verdict": ["yes"] * len(claims)})


def window(limit=1.0, in_flight=8, retries=0, give_up_after=None):
    calls, lock = [], threading.Lock()
    return CallWindow(lambda: Client(calls, lock), in_flight, retries, limit, give_up_after), calls


@pytest.mark.parametrize("in_flight", [1, 8])
def test_one_hanging_claim_costs_one_limit(in_flight):
    w, calls = window(in_flight=in_flight)
    start = time.monotonic()
    found = w.answers(pd.Series([f"c{i}" if i != 20 else "hang" for i in range(64)]), 64)
    assert 0.9 < time.monotonic() - start < 1.6
    assert [i for i, r in enumerate(found) if r[4]] == [20] and found[20][4] == "timeout"
    assert all(r[0] == "yes" and r[5] is not None for i, r in enumerate(found) if i != 20)
    assert [len(c) for c in calls] == [64] + [1] * 64


def test_failures_are_tried_again_and_isolated():
    w, calls = window(retries=2)
    found = w.answers(pd.Series(["a", "fail", "b"]), 3)
    assert [r[0] for r in found] == ["yes", None, "yes"] and found[1][4] == "RuntimeError: down"
    assert [len(c) for c in calls] == [3, 3, 3, 1, 1, 1]


def test_breaker():
    """After k failures in a row claims are not asked, but for one probe after each k; a success ends it."""
    w, calls = window(in_flight=1, give_up_after=4)
    found = w.answers(pd.Series(["fail"] * 40 + ["fine"] * 20), 10)
    down, asked = [i for i, r in enumerate(found) if r[4] == "RuntimeError: down"], [i for i, r in enumerate(found) if r[0]]
    assert down == [0, 1, 2, 3, 8, 20, 30] and asked == [40, *range(50, 60)]
    assert all("not asked: " in r[4] for i, r in enumerate(found) if i not in down + asked)
    assert [len(c) for c in calls] == [10] + [1] * 8 + [10]
    w, calls = window(limit=0.4, in_flight=4, give_up_after=4)
    start = time.monotonic()
    assert all(r[4] for r in w.answers(pd.Series(["hang"] * 64), 1))
    assert time.monotonic() - start < 8 and len(calls) <= 20


def test_order_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else f"claim {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "claim_id long, claim string")
    mv = ModelVerifier(lambda: RuleClient(log_path=None), batch_size=7, in_flight=3)
    got = {r.claim_id: r.m for r in mv.answers(df, "m", F.col("claim")).collect()}
    assert all((got[i] is None) == (c is None) for i, c in rows)
    assert all(got[i].verdict == ("yes" if len(c) % 2 == 0 else "no") for i, c in rows if c)


def joined_columns(df):
    """The names of the columns that each join of the plan reads."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            found.append({c.output().apply(i).name() for c in below for i in range(c.output().size())})
        todo += below
    return found


def test_texts_stay_where_they_are(spark, tmp_path):
    """Narrow rows are joined by digests computed before; the truth is joined only where it is selected."""
    claims = table(spark, tmp_path).drop("ground_truth")
    truth = claims.groupBy("claim_id").agg(F.max("claim_id").cast("string").alias("ground_truth"))
    made, logs = roles(tmp_path)
    made["judge"] = made["judge"].with_prefix("Again: ")
    runs = StoredCascade(claims.join(truth, "claim_id", "left"), *made.values(), AnswerStore(spark, str(tmp_path / "answers")))
    runs.where("claim_id % 10 <> 0").results()
    results = runs.results()
    assert set(asked(logs["judge"])) == {"Again: " + "z" * n for n in range(1, 61, 2)}
    narrow = results.select("claim_id", "final_verdict", "a.reasoning")
    assert results.columns == cascade(runs.claims, *(constant_verifier("x") for _ in range(3))).columns
    for df, moved in ((narrow, 1), (runs.gate().select("claim_id", "reason"), 0)):
        joins = joined_columns(df)
        assert len(joins) >= 2 and sum("claim" in j for j in joins) == moved  # the join with the truth, if any
    assert narrow.count() == 120


def test_filter_keeps_all_that_is_wanted(spark):
    rows = spark.range(20_000).select(digest_of(F.col("id").cast("string")).alias("digest"), "id")
    wanted = rows.filter("id % 1000 = 7").select("digest")
    kept = {r.id for r in perhaps_among(rows, wanted).collect()}
    assert {i for i in range(20_000) if i % 1000 == 7} <= kept and len(kept) < 200
    assert perhaps_among(rows, wanted.limit(0)).count() == 0 and perhaps_among(rows, wanted).columns == rows.columns
