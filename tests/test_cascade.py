"""Cascade semantics (FIXTURES.md F-2) and the model UDF surface."""

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import metrics as M
from verdictflow.operators.clients import RuleClient
from verdictflow.operators.cascade import cascade, forced_disagreement, split_blank_claims
from verdictflow.operators.verifiers import (ModelVerifier, RuleVerifier, TableVerifier, constant_verifier,
                                             raw_answer)


def claims(spark, n=1, truth="yes"):
    rows = [(i, f"claim number {i}", truth if not isinstance(truth, list) else truth[i]) for i in range(n)]
    return spark.createDataFrame(rows, "claim_id long, claim string, ground_truth string")


def test_disagreement_goes_to_judge(spark):
    r = cascade(claims(spark), constant_verifier("yes"), constant_verifier("no"), constant_verifier("yes"), 0.7).first()
    assert r["escalated"] and r["final_verdict"] == "yes" and r["reason"] == "disagreement"
    assert r["judge"]["verdict"] == "yes"


def test_agreement_confidence_gate(spark):
    hi = cascade(claims(spark), constant_verifier("yes", "0.8"), constant_verifier("yes", "0.9"),
                 constant_verifier("no"), 0.7).first()
    assert not hi["escalated"] and hi["min_confidence"] == pytest.approx(0.8) and hi["judge"] is None
    lo = cascade(claims(spark), constant_verifier("yes", "0.5"), constant_verifier("yes", "0.6"),
                 constant_verifier("no"), 0.7).first()
    assert lo["escalated"] and lo["reason"] == "low_confidence_agreement" and lo["final_verdict"] == "no"
    dis = cascade(claims(spark), constant_verifier("yes", "0.9"), constant_verifier("no", "0.9"),
                  constant_verifier("no"), 0.7).first()
    assert dis["escalated"]


def test_bare_mocks_escalate_at_default_confidence(spark):
    # no confidence anywhere -> 0.6 < 0.7 -> escalation (the reference's consensus test expects otherwise)
    r = cascade(claims(spark), constant_verifier("yes"), constant_verifier("yes"), constant_verifier("no"), 0.7).first()
    assert r["escalated"] and r["a"]["confidence"] == pytest.approx(0.6)


def test_counters_and_rates(spark):
    # 10 rows, 3 disagreements (escalated), 7 confident agreements
    rule = lambda c: raw_answer(F.when(F.col("claim_id") < 3, F.lit("no")).otherwise(F.lit("yes")), "0.9")  # noqa
    r = cascade(claims(spark, 10), constant_verifier("yes", "0.9"), RuleVerifier(rule), constant_verifier("yes"), 0.7)
    m = M.cascade_metrics(r).first()
    assert (m["total_evaluations"], m["escalations"], m["agreements"], m["disagreements"]) == (10, 3, 7, 3)
    assert m["escalation_rate"] == pytest.approx(0.3) and m["agreement_rate"] == pytest.approx(0.7)
    assert m["total_model_calls"] == 23 and m["avg_calls_per_evaluation"] == pytest.approx(2.3)
    e = M.evaluation_metrics(r).first()
    assert e["total_model_calls"] == 23 and e["disagreements"] == 3


def test_accuracy_with_judge_always_yes(spark):
    r = cascade(claims(spark, 2, ["yes", "no"]), constant_verifier("yes"), constant_verifier("no"),
                constant_verifier("yes"), 0.7)
    m = M.evaluation_metrics(r).first()
    assert m["correct_predictions"] == 1 and m["overall_accuracy"] == pytest.approx(0.5)


def test_row_failure_fallback(spark):
    c = claims(spark, 2).withColumn("row_error", F.when(F.col("claim_id") == 0, F.lit("backend down")))
    rows = {r["claim_id"]: r for r in cascade(c, constant_verifier("yes", "0.9"), constant_verifier("yes", "0.9"),
                                              constant_verifier("yes"), 0.7, row_error_col="row_error").collect()}
    bad, ok = rows[0], rows[1]
    assert bad["final_prediction"] == 0 and bad["escalated"] and bad["reason"] == "error"
    assert bad["a"]["confidence"] == pytest.approx(0.1) and bad["judge"]["error"] == "backend down"
    assert ok["final_verdict"] == "yes" and not ok["escalated"]


def test_blank_claims(spark):
    df = spark.createDataFrame([(0, "  \n"), (1, "real claim")], "claim_id long, claim string")
    good, bad = split_blank_claims(df)
    assert [r[0] for r in good.select("claim_id").collect()] == [1]
    assert [r[0] for r in bad.select("claim_id").collect()] == [0]
    r = cascade(df, constant_verifier("yes"), constant_verifier("yes"), constant_verifier("yes"), blank="quarantine",
                truth_col=None)
    assert r.count() == 1
    with pytest.raises(Exception, match="Claim cannot be empty"):
        cascade(df, constant_verifier("yes"), constant_verifier("yes"), constant_verifier("yes"), truth_col=None) \
            .select("claim", "final_verdict").collect()


def test_table_verifier_missing_answer(spark):
    out = spark.createDataFrame([(0, "yes", "0.9")], "claim_id long, verdict string, confidence string")
    r = cascade(claims(spark, 2), TableVerifier(out), TableVerifier(out), constant_verifier("no"), 0.7)
    rows = {x["claim_id"]: x for x in r.collect()}
    assert rows[0]["a"]["verdict"] == "yes" and not rows[0]["escalated"]
    assert rows[1]["a"]["error"] == "missing answer" and rows[1]["a"]["verdict"] == "no"


def test_forced_disagreement(spark):
    unclear = RuleVerifier(lambda c: raw_answer("unsure"))  # "cannot" would read as "no"
    r = forced_disagreement(claims(spark, 5), unclear, constant_verifier("yes"))
    got = r.agg(F.count_if("escalated"), F.count_if(F.col("final_verdict") == "yes")).first()
    assert tuple(got) == (5, 5)  # yes-biased vs no-biased always disagree, the judge decides


def test_gamma_as_column(spark):
    c = claims(spark, 2).withColumn("g", F.when(F.col("claim_id") == 0, F.lit(0.5)).otherwise(F.lit(0.95)))
    r = cascade(c, constant_verifier("yes", "0.9"), constant_verifier("yes", "0.9"), constant_verifier("no"),
                F.col("g"), "p2")
    got = {x["claim_id"]: x["escalated"] for x in r.collect()}
    assert got == {0: False, 1: True}  # P2: 0.8 confidence


def test_model_verifier_isolates_errors_and_timeouts(spark):
    df = spark.createDataFrame([(0, "good one"), (1, "bad one"), (2, "slow one"), (3, "fine!")],
                               "claim_id long, claim string")
    mv = ModelVerifier(lambda: RuleClient(fail_on="bad", slow_on="slow"), batch_size=4, retries=0, timeout_s=1.0)
    got = {r["claim_id"]: r["m"] for r in mv.answers(df, "m", F.col("claim")).collect()}
    assert got[0]["verdict"] == "yes" and got[0]["error"] is None and got[0]["elapsed_ms"] is not None
    assert "model crashed" in got[1]["error"]
    assert got[2]["error"] == "timeout"
    assert got[3]["verdict"] == "no"


def test_judge_called_only_for_escalated_rows(spark, tmp_path):
    from pyspark.sql import Observation
    log = str(tmp_path / "judge.log")
    a = ModelVerifier(RuleClient)
    b = constant_verifier("yes", "0.95")
    j = ModelVerifier(lambda: RuleClient(log_path=log))
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)], "claim_id long, claim string")
    obs = Observation("calls")
    r = cascade(df, a, b, j, 0.7, truth_col=None, observation=obs)
    esc = r.agg(F.count_if("escalated")).first()[0]
    m = obs.get
    sent = open(log).read().splitlines()
    assert esc == 20 and m["escalations"] == 20 and m["judge_calls"] == 20 and m["rows"] == 40
    assert len(sent) == 20 and all(len(c) % 2 == 1 for c in sent)  # only the rows A answered 'no' on
    # a filter after the cascade plans quickly (the observe node stops push-down)
    assert cascade(df, a, b, j, 0.7, truth_col=None).filter("escalated AND judge.error IS NULL").count() == 20


def test_join_answers_one_join(spark):
    from verdictflow.operators.verifiers import join_answers
    out = spark.createDataFrame([(0, "a", "yes", "0.9"), (0, "b", "yes", "0.95"), (0, "judge", "no", None),
                                 (1, "a", "yes", "0.9"), (1, "b", "no", "0.9"), (1, "judge", "no", None)],
                                "claim_id long, role string, verdict string, confidence string")
    c, (a, b, j) = join_answers(claims(spark, 3), out)
    r = {x["claim_id"]: x for x in cascade(c, a, b, j, 0.7).collect()}
    assert not r[0]["escalated"] and r[0]["final_verdict"] == "yes"
    assert r[1]["escalated"] and r[1]["final_verdict"] == "no"
    assert r[2]["a"]["error"] == "missing answer"
    plan = cascade(c, a, b, j, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2  # one join (the plan string may name it twice: SMJ/BHJ + AQE)


def test_materialized_cascade_calls_models_once(spark, tmp_path):
    from verdictflow.plans import sweep as S
    log = str(tmp_path / "a.log")
    a = ModelVerifier(lambda: RuleClient(log_path=log))
    df = spark.createDataFrame([(i, "y" * (i + 1), "yes") for i in range(30)],
                               "claim_id long, claim string, ground_truth string")
    r = S.sweep_results(df, a, constant_verifier("yes", "0.8"), constant_verifier("no"), [0.5, 0.9])
    S.gamma_sweep(r, [0.5, 0.9]).collect()
    M.evaluation_metrics(r).collect()
    r.count()
    assert len(open(log).read().splitlines()) == 30  # three uses, one model pass


def test_evaluate_claim_and_dataset(spark):
    from verdictflow.operators.cascade import evaluate_claim, evaluate_dataset
    r = evaluate_claim(spark, "The sky is blue.", constant_verifier("yes", "0.9"), constant_verifier("yes", "0.9"),
                       constant_verifier("no"), 0.7, ground_truth="yes")
    assert r["final_verdict"] == "yes" and not r["escalated"] and r["correct"]
    with pytest.raises(ValueError, match="empty"):
        evaluate_claim(spark, "  ", constant_verifier("yes"), constant_verifier("yes"), constant_verifier("no"))
    ds = spark.createDataFrame([(0, "a", "true"), (1, "b", "0")], "claim_id long, claim string, label string")
    out = {x["claim_id"]: x for x in evaluate_dataset(ds, constant_verifier("yes", "0.9"),
                                                       constant_verifier("yes", "0.9"), constant_verifier("no")).collect()}
    assert out[0]["ground_truth"] == "yes" and out[0]["correct"] and out[1]["correct"] is False
    with pytest.raises(ValueError, match="Invalid labels"):
        evaluate_dataset(spark.createDataFrame([(0, "a", "Yes")], "claim_id long, claim string, label string"),
                         constant_verifier("yes"), constant_verifier("yes"), constant_verifier("no"))


def test_attach_truth_and_judge_partitions(spark):
    from verdictflow.operators.cascade import attach_truth
    df = spark.createDataFrame([(i, f"claim {i}") for i in range(6)], "claim_id long, claim string")
    rule = lambda c: raw_answer(F.when(F.col("claim_id") % 2 == 0, F.lit("no")).otherwise(F.lit("yes")), "0.9")  # noqa
    r = cascade(df, constant_verifier("yes", "0.9"), RuleVerifier(rule), constant_verifier("no"), 0.7, truth_col=None,
                judge_partitions=3)
    truth = spark.createDataFrame([(i, "no" if i < 3 else "yes") for i in range(5)], "claim_id long, ground_truth string")
    got = {x["claim_id"]: x for x in attach_truth(r, truth).collect()}
    # even ids disagree -> judge 'no'; odd ids agree confidently -> 'yes'
    assert [got[i]["final_verdict"] for i in range(6)] == ["no", "yes", "no", "yes", "no", "yes"]
    assert [got[i]["correct"] for i in range(6)] == [True, False, True, True, False, None]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(claim_id" in plan


@pytest.mark.parametrize("use", ["count", "one column", "metrics"])
def test_blank_claims_fail_whatever_is_selected(spark, use):
    from verdictflow.operators.metrics import evaluation_metrics
    a, j = constant_verifier("yes"), constant_verifier("no")
    claims = spark.createDataFrame([(1, "fine", "yes"), (2, " \n", "no")], "claim_id long, claim string, ground_truth string")
    r = cascade(claims, a, a, j, 0.7)
    with pytest.raises(Exception, match="Claim cannot be empty"):
        r.count() if use == "count" else r.select("escalated").collect() if use == "one column" \
            else evaluation_metrics(r).collect()


def test_kept_blank_claims_are_not_sent(spark):
    a, j = constant_verifier("yes", confidence="0.9"), constant_verifier("yes")
    claims = spark.createDataFrame([(1, "fine"), (2, "  "), (3, None)], "claim_id long, claim string")
    r = {x["claim_id"]: x for x in cascade(claims, a, a, j, 0.7, truth_col=None, blank="keep").collect()}
    assert r[1]["final_verdict"] == "yes" and {r[2]["final_verdict"], r[3]["final_verdict"]} == {"no"}
    assert r[2]["a"]["reasoning"] == "Empty claim" == r[3]["judge"]["reasoning"] and r[2]["a"]["confidence"] == 0.6


def test_sweep_beyond_the_cascade_fails(spark):
    from verdictflow.plans.sweep import gamma_sweep
    a, j = constant_verifier("yes", confidence="0.5"), constant_verifier("no")
    claims = spark.createDataFrame([(i, f"claim {i}", "no") for i in range(9)], "claim_id long, claim string, ground_truth string")
    low = cascade(claims, a, a, j, 0.1)
    assert gamma_sweep(low, [0.1]).count() == 1
    with pytest.raises(Exception, match="the judge was not asked"):
        gamma_sweep(low, [0.1, 0.9]).collect()
