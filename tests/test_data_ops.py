"""Sampling / positions, datasets and sinks, validation, comparison, catalogue, streaming."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.operators import catalog as CAT
from verdictflow.operators import metrics as M
from verdictflow.operators import sampling as SM
from verdictflow.operators import validation as V
from verdictflow.operators.cascade import cascade
from verdictflow.plans import compare as C
from verdictflow.sources import datasets as D
from verdictflow.sources import sinks as K
from verdictflow.sources.derived import document_claims, fixture_verifiers, text_key


def test_dense_index_matches_brute_force(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("v"))
    got = SM.dense_index(df, ["k"], "pos", partitions=7, sums={"cum_v": F.col("v")}).collect()
    rows = sorted((r["k"], r["v"]) for r in df.collect())
    cum = np.cumsum([v for _, v in rows])
    want = {k: (i, int(cum[i])) for i, (k, _) in enumerate(rows)}
    assert {r["k"]: (r["pos"], r["cum_v"]) for r in got} == want


def test_top_n_large_path_equals_small_path(spark):
    df = spark.range(0, 30000).withColumn("h", F.md5(F.col("id").cast("string")))
    small = [r[0] for r in df.orderBy("h", "id").limit(12000).select("id").collect()]
    big = sorted(r[0] for r in SM.top_n(df, 12000, ["h", "id"]).select("id").collect())
    assert sorted(small) == big


def test_sample_n_is_seeded_and_exact(spark, sf):
    c = document_claims(spark, sf, with_text=False)
    a = {r[0] for r in SM.sample_n(c, 10, 3).select("claim_id").collect()}
    b = {r[0] for r in SM.sample_n(c, 10, 3).select("claim_id").collect()}
    assert a == b and len(a) == 10
    ids = sorted((hashlib.md5(f"3:sample:{r[0]}".encode()).hexdigest(), r[0]) for r in c.select("claim_id").collect())
    assert a == {i for _, i in ids[:10]}


def test_balanced_sample_rounds(spark):
    pool = spark.createDataFrame([(i, "yes" if i < 15 else "no") for i in range(18)],
                                 "claim_id long, ground_truth string")
    s = SM.balanced_sample(pool, 21, seed=1).collect()  # 21 -> 22, 11 per class; 'no' pool of 3 -> 4 rounds
    yes = [r for r in s if r["ground_truth"] == "yes"]
    no = [r for r in s if r["ground_truth"] == "no"]
    assert len(yes) == 11 and len(no) == 11
    assert len({r["claim_id"] for r in yes}) == 11
    assert sorted(r["round"] for r in no) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def test_synthetic_alternating(spark, sf):
    pool = document_claims(spark, sf, with_text=False)
    truth = {r[0]: r[1] for r in pool.select("claim_id", "ground_truth").collect()}
    rows = SM.synthetic_alternating(spark, pool, 50, seed=0).collect()
    assert len(rows) == 50
    for r in rows:
        assert r["ground_truth"] == ("yes" if r["i"] % 2 == 0 else "no") == truth[r["claim_id"]]


def test_running_rates(spark, sf):
    a, b, j = fixture_verifiers()
    r = cascade(document_claims(spark, sf), a, b, j, 0.7)
    rows = sorted(r.select("claim_id", "escalated").collect())
    got = {x["i"]: x["escalation_rate"] for x in SM.running_rates(r).collect()}
    for i, rate in got.items():
        assert rate == pytest.approx(sum(e for _, e in rows[: i + 1]) / (i + 1))
    assert set(got) == {i for i in range(1, len(rows)) if i % 10 == 0}


def test_json_csv_roundtrip(spark, tmp_path):
    rec = tmp_path / "records.json"
    rec.write_text(json.dumps([{"claim": "a, \"quoted\"\nclaim", "label": "yes"}, {"claim": "b", "label": "0"}]))
    cols = tmp_path / "cols.json"
    cols.write_text(json.dumps({"claims": ["x", "y", "z"], "labels": ["no", "yes", "true"], "size": 3}))
    r = D.read_claims(spark, str(rec)).orderBy("claim").collect()
    assert [(x["claim"], x["label"]) for x in r] == [("a, \"quoted\"\nclaim", "yes"), ("b", "0")]
    c = D.read_claims(spark, str(cols)).orderBy("claim_id").collect()
    assert [(x["claim_id"], x["claim"], x["label"]) for x in c] == [(0, "x", "no"), (1, "y", "yes"), (2, "z", "true")]
    df = spark.createDataFrame([(0, "a, \"q\"\nb", "yes"), (1, "plain", "no")], "claim_id long, claim string, label string")
    for suffix in (".csv", ".json", ".jsonl", ".parquet"):
        p = str(tmp_path / f"out{suffix}")
        K.save_dataset(df, p, metadata={"source": "test"}, max_rows=1000)
        back = sorted((x["claim"], x["label"]) for x in D.read_claims(spark, p).collect())
        assert back == [("a, \"q\"\nb", "yes"), ("plain", "no")], suffix
    with pytest.raises(ValueError, match="Unsupported file format"):
        D.read_claims(spark, str(tmp_path / "x.txt"))
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps([{"claim": "only claim"}]))
    with pytest.raises(Exception, match="missing key: label"):
        D.read_claims(spark, str(bad)).collect()


def test_named_datasets(spark):
    pool = spark.createDataFrame([(i, f"claim {i}", "yes" if i % 2 else "no") for i in range(30)],
                                 "claim_id long, claim string, label string")
    sets = {"test": pool, "hard": pool.limit(16)}
    t = D.load_named_dataset(spark, "test", 20, seed=0, named=sets)
    labels = [r["label"] for r in t.collect()]
    assert len(labels) == 20 and labels.count("yes") == 10
    odd = D.load_named_dataset(spark, "test", 7, seed=0, named=sets).collect()
    assert len(odd) == 7  # rounded up to 8, then one dropped (quirk Q18)
    assert D.load_named_dataset(spark, "hard", named=sets).count() == 16
    with pytest.raises(ValueError, match="Unknown dataset|Unsupported"):
        D.load_named_dataset(spark, "no_such_dataset")


def test_ids_do_not_collide(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "d.json").mkdir(exist_ok=True)
        (tmp_path / "d.json" / f"{name}.json").write_text(json.dumps({"claims": ["x", "y"], "labels": ["yes", "no"]}))
    (tmp_path / "d.json" / "c.json").write_text(json.dumps([{"claim": "z", "label": "no"}]))
    got = D.read_claims(spark, str(tmp_path / "d.json")).collect()
    assert len(got) == 5 and len({r["claim_id"] for r in got}) == 5
    some = tmp_path / "some.jsonl"
    some.write_text('{"claim_id": 1, "claim": "a", "label": "yes"}\n{"claim": "b", "label": "no"}\n')
    with pytest.raises(Exception, match="claim_id is missing"):
        D.read_claims(spark, str(some)).count()
    none = tmp_path / "none.jsonl"
    none.write_text('{"claim": "a", "label": "yes"}\n{"claim": "b", "label": "no"}\n')
    assert len({r["claim_id"] for r in D.read_claims(spark, str(none)).collect()}) == 2


def test_validation(spark):
    ok = spark.createDataFrame([("yes",), ("no",), ("true",), ("0",)], "label string")
    s = V.validate_dataset(ok, require_balanced=True)
    assert s["positive"] == 2 and s["balanced"]
    bad = spark.createDataFrame([("Yes",), ("no",)], "label string")
    with pytest.raises(ValueError, match="Invalid labels found"):
        V.validate_dataset(bad)  # case-sensitive, before normalising (quirk Q9)
    unbalanced = spark.createDataFrame([("yes",)] * 3 + [("no",)], "label string")
    with pytest.raises(ValueError, match="not balanced"):
        V.validate_dataset(unbalanced, require_balanced=True)
    with pytest.raises(ValueError, match="empty"):
        V.validate_dataset(spark.createDataFrame([], "label string"))
    n = V.normalize_labels(spark.createDataFrame([(" TRUE ",), ("0",)], "label string")).collect()
    assert [r[0] for r in n] == ["yes", "no"]
    with pytest.raises(Exception, match="Cannot normalize label"):
        V.normalize_labels(spark.createDataFrame([("maybe",)], "label string")).collect()
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    labels = spark.createDataFrame([(1, "yes")], "claim_id long, label string")
    with pytest.raises(ValueError, match="must match"):
        V.validate_dataset(labels, claims=claims)


def test_student_t_p_value():
    assert C.student_t_two_sided_p(2.262, 9) == pytest.approx(0.05, abs=2e-4)
    assert C.student_t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert C.student_t_two_sided_p(1.0, 1) == pytest.approx(0.5)  # Cauchy: 1 - 2*atan(1)/pi
    assert math.isnan(C.student_t_two_sided_p(float("nan"), 3))


def test_paired_ttest_against_numpy(spark, sf):
    a, b, j = fixture_verifiers()
    ra = cascade(document_claims(spark, sf), a, b, j, 0.3)
    rb = cascade(document_claims(spark, sf), a, b, j, 0.9)
    got = C.paired_ttest(ra, rb).first()
    p = C.paired_runs(ra, rb).select("hit_a", "hit_b").collect()
    ha, hb = np.array([x[0] for x in p]), np.array([x[1] for x in p])
    d = ha - hb
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    assert got["t_statistic"] == pytest.approx(t) and got["cohens_d"] == pytest.approx(d.mean() / d.std())
    assert got["p_value"] == pytest.approx(C.student_t_two_sided_p(t, len(d) - 1))
    same = C.paired_ttest(ra, ra).first()
    assert same["t_statistic"] is None and same["cohens_d"] == 0.0 and not same["significant"]


def test_summary_stats_and_compare(spark):
    cfg = spark.createDataFrame([(0.5, 2.0, 0.1), (0.7, 2.4, 0.4), (0.9, 3.0, 1.0)],
                                "overall_accuracy double, avg_calls_per_evaluation double, escalation_rate double")
    s = {r["metric"]: r for r in C.summary_stats(cfg).collect()}
    acc = np.array([0.5, 0.7, 0.9])
    assert s["overall_accuracy"]["std"] == pytest.approx(acc.std()) and s["overall_accuracy"]["median"] == 0.7
    res = spark.createDataFrame(
        [("A", 0, 1, "yes", True, True), ("A", 0, 0, "no", False, True), ("B", 1, 1, "yes", True, False),
         ("B", 1, 1, "no", True, True)],
        "config string, pos int, final_prediction int, ground_truth string, escalated boolean, agree boolean")
    c = {r["config"]: r for r in C.compare_configs(res, "config", "pos").collect()}
    assert c["A"]["best_accuracy"] and not c["B"]["best_accuracy"]
    assert c["A"]["lowest_cost"] != c["B"]["lowest_cost"]


def test_catalog(spark):
    avail = spark.createDataFrame([("alpha3.2:latest", 0), ("beta:7b-q4", 1), ("delta3", 2)], "model string, pos int")
    req = spark.createDataFrame([("delta3",), ("epsilon:2b",)], "model string")
    assert CAT.all_present(req, avail) == (False, ["epsilon:2b"])
    assert CAT.pick_model(avail, "beta:7b", "beta").first()[0] == "beta:7b-q4"
    assert CAT.pick_model(avail, "alpha2:7b", "alpha2").first()[0] == "alpha3.2:latest"
    assert CAT.pick_model(avail, "x", "none", fallback="last").first()[0] == "delta3"


def test_streaming_counters_equal_batch(spark, sf, tmp_path):
    from verdictflow.streaming.stream import counter_frame, event_claims, read_counters, stream_counters, stream_table
    a, b, j = fixture_verifiers()
    r = cascade(event_claims(stream_table(spark, sf, "events")).withColumn("text_key", text_key("claim")), a, b, j, 0.7, truth_col=None)
    q = stream_counters(r, str(tmp_path / "sink"), str(tmp_path / "ckpt"), by="event_type")
    q.awaitTermination()
    got = {x["event_type"]: x.asDict() for x in read_counters(spark, str(tmp_path / "sink"), "event_type").collect()}
    ev = spark.read.parquet(f"{sf}/events.parquet")
    batch = counter_frame(cascade(event_claims(ev).withColumn("text_key", text_key("claim")), a, b, j, 0.7, truth_col=None), by="event_type").collect()
    assert {x["event_type"]: x.asDict() for x in batch} == got


def test_sinks(spark, sf, tmp_path):
    a, b, j = fixture_verifiers()
    r = cascade(document_claims(spark, sf), a, b, j, 0.7)
    K.save_results(r, str(tmp_path / "res"), gamma=0.7)
    back = spark.read.json(str(tmp_path / "res/results"))
    assert back.count() == r.count() and "a" in back.columns
    rid = K.run_manifest(r, str(tmp_path / "runs"), {"gamma": 0.7})
    assert spark.read.parquet(str(tmp_path / "runs/results")).filter(F.col("run_id") == rid).count() == r.count()
    log = K.append_run_log(spark, str(tmp_path / "log"), "x", 1, 0.1, M.evaluation_metrics(r))
    log = K.append_run_log(spark, str(tmp_path / "log"), "y", 1, 0.1, M.evaluation_metrics(r))
    assert log.count() == 2
    assert os.path.exists(str(tmp_path / "res/metadata"))


def test_config_validation(spark):
    from verdictflow.operators.config import CascadeConfig, VerifierSpec
    cfg = CascadeConfig()
    assert (cfg.verifier_a.temperature, cfg.verifier_b.temperature, cfg.judge.temperature) == (0.1, 0.9, 0.0)
    with pytest.raises(ValueError):
        cfg.with_gamma(1.5)  # overrides are checked too (quirk Q13)
    with pytest.raises(ValueError):
        VerifierSpec("m", temperature=-0.1)
    assert cfg.roster(spark).count() == 3


def test_report_rendering(spark, sf):
    from verdictflow.plans import sweep as S
    from verdictflow.plans.report import render_report, sweep_report_rows
    a, b, j = fixture_verifiers()
    sw = S.gamma_sweep(cascade(document_claims(spark, sf), a, b, j, 0.95))
    text = render_report(sweep_report_rows(sw))
    assert "best_accuracy" in text and "%" in text and text.count("\n") > 10


def test_streaming_update_mode(spark, sf, tmp_path):
    from verdictflow.streaming.stream import counter_frame, event_claims, read_counters, stream_counters, stream_table
    a, b, j = fixture_verifiers()
    r = cascade(event_claims(stream_table(spark, sf, "events", max_files_per_trigger=1)).withColumn("text_key", text_key("claim")), a, b, j, 0.7,
                truth_col=None)
    q = stream_counters(r, str(tmp_path / "sink"), str(tmp_path / "ckpt"), by="event_type", output_mode="update")
    q.awaitTermination()
    got = {x["event_type"]: x.asDict() for x in read_counters(spark, str(tmp_path / "sink"), "event_type").collect()}
    ev = spark.read.parquet(f"{sf}/events.parquet")
    batch = counter_frame(cascade(event_claims(ev).withColumn("text_key", text_key("claim")), a, b, j, 0.7, truth_col=None), by="event_type").collect()
    assert {x["event_type"]: x.asDict() for x in batch} == got


def test_evaluation_file_holds_all_fields(spark, tmp_path):
    from verdictflow.operators.config import CascadeConfig
    from verdictflow.operators.verifiers import RuleVerifier, raw_answer
    v = RuleVerifier(lambda claim: raw_answer("yes", "0.9", "r" * 200, elapsed_ms=500.0))
    claims = spark.createDataFrame([(1, "one", "no", None), (2, "two", None, None), (3, "three", "yes", "timeout"),
                                    (4, "four", None, "broken")],
                                   "claim_id long, claim string, ground_truth string, row_error string")
    config = CascadeConfig(gamma=0.95)
    r = cascade(claims, v, v, v, config=config, row_error_col="row_error")
    got = {(x["type"], x["claim_id"]): x for x in K.write_evaluation(r, str(tmp_path / "f"), config, seed=5).collect()}
    assert len(got) == 6 and got["metadata", None]["gamma"] == 0.95 and got["metadata", None]["models"]["referee"] == "judge"
    one, two, three, four = (got[k] for k in (("labeled", 1), ("contested_factual", 2), ("labeled", 3), ("contested_factual", 4)))
    assert (one["claim"], one["predicted"], one["correct"], one["time"], one["ref_confidence"]) == ("one", "yes", False, 1.5, 0.9)
    assert two["a_reasoning"] == "r" * 150 + "..." and two["final"] == 1 and two["expected"] is None and two["escalated"]
    assert (three["error"], three["correct"], three["escalated"], three["time"]) == ("timeout", False, False, None)
    assert (four["error"], four["correct"], four["escalated"], four["final"]) == ("broken", None, False, None)
    assert got["summary", None]["contested_factual_escalation_rate"] == 0.5
