"""Metric identities, and the prefix-sum sweep against a brute-force per-gamma evaluation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictflow.operators import metrics as M
from verdictflow.operators.cascade import cascade
from verdictflow.operators.verifiers import RuleVerifier, raw_answer
from verdictflow.plans import sweep as S
from verdictflow.sources.derived import all_claims, document_claims, fixture_verifiers

GAMMAS = [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95]


@pytest.fixture(scope="module")
def base(spark, sf):
    a, b, j = fixture_verifiers()
    return document_claims(spark, sf), (a, b, j)


def test_identities(base):
    claims, (a, b, j) = base
    for g in (0.3, 0.7, 0.95):
        m = M.evaluation_metrics(cascade(claims, a, b, j, g)).first()
        assert m["agreements"] + m["disagreements"] == m["total_evaluations"]
        assert m["avg_calls_per_evaluation"] == pytest.approx(2 + m["escalation_rate"])
        if m["non_escalated_accuracy"] is not None:
            assert m["false_consensus_rate"] == pytest.approx(1 - m["non_escalated_accuracy"])
        assert m["efficiency"] == pytest.approx(m["overall_accuracy"] / m["avg_calls_per_evaluation"])


def test_sweep_equals_per_gamma_cascades(base):
    claims, (a, b, j) = base
    sw = {r["pos"]: r for r in S.gamma_sweep(cascade(claims, a, b, j, max(GAMMAS)), GAMMAS).collect()}
    for pos, g in enumerate(GAMMAS):
        brute = M.evaluation_metrics(cascade(claims, a, b, j, g)).first().asDict()
        got = sw[pos].asDict()
        for k, v in brute.items():
            assert got[k] == pytest.approx(v, nan_ok=True), (g, k)


def test_sweep_monotone_and_unsorted_duplicate_gammas(base):
    claims, (a, b, j) = base
    gs = [0.9, 0.1, 0.5, 0.5]
    rows = S.gamma_sweep(cascade(claims, a, b, j, max(gs)), gs).orderBy("pos").collect()
    assert [r["gamma"] for r in rows] == gs
    assert rows[2]["escalations"] == rows[3]["escalations"]
    by_g = sorted(rows, key=lambda r: r["gamma"])
    assert all(x["escalation_rate"] <= y["escalation_rate"] for x, y in zip(by_g, by_g[1:]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.0, 1.0, allow_nan=False), min_size=1, max_size=6), st.integers(0, 10_000))
def test_sweep_random_confidences(spark, gammas, seed):
    rnd = random.Random(seed)
    rows = [(i, f"c{i}", rnd.choice(["yes", "no"]), f"{rnd.choice([0.2, 0.5, 0.7, 0.9, 1.0])}",
             rnd.choice(["yes", "no"]), f"{rnd.random():.3f}", rnd.choice(["yes", "no"])) for i in range(60)]
    df = spark.createDataFrame(rows, "claim_id long, claim string, ground_truth string, ca string, vb string, "
                                     "cb string, vj string")
    a = RuleVerifier(lambda c: raw_answer(F.lit("yes"), F.col("ca")))
    b = RuleVerifier(lambda c: raw_answer(F.col("vb"), F.col("cb")))
    j = RuleVerifier(lambda c: raw_answer(F.col("vj")))
    sw = {r["pos"]: r for r in S.gamma_sweep(cascade(df, a, b, j, max(gammas)), gammas).collect()}
    for pos, g in enumerate(gammas):
        brute = M.evaluation_metrics(cascade(df, a, b, j, g)).first()
        assert sw[pos]["escalations"] == brute["escalations"]
        assert sw[pos]["correct_predictions"] == brute["correct_predictions"]
        assert sw[pos]["f1_score"] == pytest.approx(brute["f1_score"], nan_ok=True)


def test_gamma_decisions_matches_sweep(base):
    claims, (a, b, j) = base
    r = cascade(claims, a, b, j, max(GAMMAS))
    d = S.gamma_decisions(r, GAMMAS).groupBy("pos").agg(F.count_if("escalated").alias("e")).collect()
    sw = {x["pos"]: x["escalations"] for x in S.gamma_sweep(r, GAMMAS).collect()}
    assert {x["pos"]: x["e"] for x in d} == sw


def test_best_rows_first_tie_wins(spark):
    sw = spark.createDataFrame([(0, 0.1, 0.5, 2.0, 0.1), (1, 0.5, 0.7, 2.5, 0.2), (2, 0.9, 0.7, 2.5, 0.0)],
                               "pos int, gamma double, overall_accuracy double, avg_calls_per_evaluation double, "
                               "false_consensus_rate double")
    assert S.best_accuracy(sw).first()["gamma"] == 0.5
    assert S.lowest_cost(sw).first()["gamma"] == 0.1
    assert S.lowest_fcr(sw).first()["gamma"] == 0.9
    assert S.best_efficiency(sw).first()["gamma"] == 0.5


def test_sweep_plan_has_no_cross_join(base):
    claims, (a, b, j) = base
    plan = S.gamma_sweep(cascade(claims, a, b, j, 0.95), GAMMAS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("policy", ["p2", "p3"])
def test_sweep_other_policies_match_brute_force(base, policy):
    claims, (a, b, j) = base
    gs = [0.3, 0.6, 0.9]
    sw = {r["pos"]: r for r in S.gamma_sweep(cascade(claims, a, b, j, max(gs), policy), gs, policy=policy).collect()}
    for pos, g in enumerate(gs):
        brute = M.evaluation_metrics(cascade(claims, a, b, j, g, policy)).first()
        assert sw[pos]["escalations"] == brute["escalations"], (policy, g)
        assert sw[pos]["correct_predictions"] == brute["correct_predictions"], (policy, g)
        assert sw[pos]["false_consensus_rate"] == pytest.approx(brute["false_consensus_rate"], nan_ok=True)


def test_claims_without_a_truth(spark, sf):
    """They are answered, escalated, costed and counted; accuracies are those of the labelled rows."""
    claims = all_claims(spark, sf)
    assert claims.count() == spark.read.parquet(f"{sf}/documents.parquet").count() > claims.filter("ground_truth IS NOT NULL").count()
    verifiers = fixture_verifiers()
    every, labelled = (cascade(c, *verifiers, 0.7) for c in (claims, claims.filter("ground_truth IS NOT NULL")))
    m, part = M.evaluation_metrics(every).first(), M.evaluation_metrics(labelled).first()
    assert m["total_evaluations"] == claims.count() and m["escalations"] > part["escalations"]
    assert m["total_model_calls"] == 2 * m["total_evaluations"] + m["escalations"]
    for c in ("correct_predictions", "overall_accuracy", "escalated_accuracy", "non_escalated_accuracy", "precision", "recall",
              "f1_score", "false_consensus_rate", "cost_per_correct"):
        assert m[c] == part[c], c
    h, part = M.harness_metrics(every).first(), M.harness_metrics(labelled).first()
    assert all(h[c] == part[c] for c in ("accuracy", "escalated_accuracy", "non_escalated_accuracy", "false_consensus_rate"))
    none = M.evaluation_metrics(cascade(claims.filter("ground_truth IS NULL"), *verifiers, 0.7)).first()
    assert none["total_evaluations"] > 0 and none["overall_accuracy"] is None and none["correct_predictions"] == 0
