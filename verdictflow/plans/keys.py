"""Key definitions for ``__spark_entry__.queries()`` / ``oracle_sql()``.

Inputs are the driver tables; claims are ``documents JOIN labels`` with the
derived answers of ``sources.derived`` (see FIXTURES.md, F-6).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictflow.operators import metrics as M
from verdictflow.operators.cascade import cascade
from verdictflow.plans import oracle as O
from verdictflow.plans import sweep as S
from verdictflow.plans.registry import register, with_ctes
from verdictflow.sources.derived import all_claims, document_claims, fixture_verifiers

GAMMA = 0.7
GAMMAS = S.DEFAULT_GAMMAS

def flat_cols():
    """The flattened result view (no structs), same columns as ``oracle.FLAT_COLS``."""
    return ["claim_id", "lang", "ground_truth", F.col("a.verdict").alias("a_verdict"),
            F.col("a.prediction").alias("a_prediction"), F.col("a.confidence").alias("a_confidence"),
            F.col("b.verdict").alias("b_verdict"), F.col("b.prediction").alias("b_prediction"),
            F.col("b.confidence").alias("b_confidence"), F.col("judge.verdict").alias("judge_verdict"),
            F.col("judge.prediction").alias("judge_prediction"), F.col("judge.confidence").alias("judge_confidence"),
            "agree", "min_confidence", "escalated", "reason", "final_prediction", "final_verdict", "correct",
            "calls"]
FLAT_DOUBLES = ("a_confidence", "b_confidence", "judge_confidence", "min_confidence")

METRIC_DOUBLES = ("overall_accuracy", "escalated_accuracy", "non_escalated_accuracy", "escalation_rate",
                  "disagreement_rate", "agreement_rate", "avg_calls_per_evaluation", "cost_per_correct",
                  "false_consensus_rate", "precision", "recall", "f1_score", "efficiency")


def results(spark, sf_dir, gamma=GAMMA, policy="p1", **kw):
    a, b, j = fixture_verifiers()
    return cascade(document_claims(spark, sf_dir), a, b, j, gamma, policy, **kw)


def metric_sql(cols, by="lang", policy="p1", gamma=GAMMA, **kw):
    k = by or ""
    sel = (k + ", " if k else "") + ", ".join(cols)
    return with_ctes(O.cascade_ctes(gamma=gamma, policy=policy, **kw) +
                     f",\ns AS ({O.sums_sql('res', k)}),\nm AS (SELECT {(k + ', ') if k else ''}{O.derive_sql()} FROM s)",
                     f"SELECT {sel} FROM m")


def metric_key(name, cols, by="lang", policy="p1", gamma=GAMMA):
    doubles = tuple(c for c in cols if c in METRIC_DOUBLES)

    @register(name, metric_sql(cols, by, policy, gamma), doubles)
    def _q(spark, sf_dir):
        r = results(spark, sf_dir, gamma, policy)
        return M.evaluation_metrics(r, by).select(*([by] if by else []), *cols)
    return _q


# ----------------------------------------------------------------- D12 flagship + D6-D11
@register("cascade", with_ctes(O.cascade_ctes(), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_cascade(spark, sf_dir):
    return results(spark, sf_dir).select(*flat_cols())


metric_key("eval_counts", ["total_evaluations", "escalations", "agreements", "disagreements"])
metric_key("eval_accuracy", ["total_evaluations", "correct_predictions", "overall_accuracy", "escalated_accuracy",
                             "non_escalated_accuracy"])
metric_key("eval_rates", ["escalation_rate", "disagreement_rate", "agreement_rate"])
metric_key("eval_cost", ["total_model_calls", "avg_calls_per_evaluation", "cost_per_correct"])
metric_key("false_consensus", ["escalations", "non_escalated_accuracy", "false_consensus_rate"])
metric_key("precision_recall", ["precision", "recall", "f1_score"])
metric_key("efficiency", ["overall_accuracy", "avg_calls_per_evaluation", "efficiency"])
metric_key("evaluation_metrics", ["total_evaluations", "escalations", "agreements", "disagreements",
                                  "correct_predictions", "overall_accuracy", "escalated_accuracy",
                                  "non_escalated_accuracy", "escalation_rate", "disagreement_rate", "agreement_rate",
                                  "total_model_calls", "avg_calls_per_evaluation", "cost_per_correct",
                                  "false_consensus_rate", "precision", "recall", "f1_score", "efficiency"], by=None)


# ----------------------------------------------------------------- all documents, truth optional
def all_results(spark, sf_dir, gamma=GAMMA):
    return cascade(all_claims(spark, sf_dir), *fixture_verifiers(), gamma)


@register("cascade_all", with_ctes(O.cascade_ctes(claims=O.claims_sql()), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_cascade_all(spark, sf_dir):
    return all_results(spark, sf_dir).select(*flat_cols())


@register("evaluation_metrics_all", with_ctes(O.cascade_ctes(claims=O.claims_sql()), O.optional_truth_sql("res", "lang")),
          METRIC_DOUBLES)
def q_evaluation_metrics_all(spark, sf_dir):
    return M.evaluation_metrics(all_results(spark, sf_dir), "lang")


@register("gamma_sweep_all", with_ctes(O.sweep_ctes(GAMMAS, claims=O.claims_sql()),
                                       O.optional_truth_sql("res", "pos, gamma")), ("gamma",) + METRIC_DOUBLES)
def q_gamma_sweep_all(spark, sf_dir):
    return S.gamma_sweep(all_results(spark, sf_dir, max(GAMMAS)), GAMMAS).drop("positive", "negative")


# ----------------------------------------------------------------- F15 sweep
SWEEP_COLS = ["total_evaluations", "escalations", "agreements", "disagreements", "correct_predictions",
              "overall_accuracy", "escalated_accuracy", "non_escalated_accuracy", "escalation_rate",
              "disagreement_rate", "agreement_rate", "total_model_calls", "avg_calls_per_evaluation",
              "cost_per_correct", "false_consensus_rate", "precision", "recall", "f1_score", "efficiency"]


def sweep_sql(by=None, policy="p1", gammas=GAMMAS, select=None, extra_ctes=""):
    k = ["pos", "gamma_in"] + ([by] if by else [])
    ks = ", ".join(k)
    base = O.sweep_ctes(gammas, policy) + f",\ns AS ({O.sums_sql('res', ks)})" + \
        f",\nsw AS (SELECT {(by + ', ') if by else ''}pos, gamma_in AS gamma, {O.derive_sql()} FROM s)" + extra_ctes
    return with_ctes(base, select or f"SELECT {(by + ', ') if by else ''}pos, gamma, {', '.join(SWEEP_COLS)} FROM sw")


def sweep_df(spark, sf_dir, by=None, policy="p1", gammas=GAMMAS):
    r = results(spark, sf_dir, max(gammas), policy)
    return S.gamma_sweep(r, gammas, by=by, policy=policy)


@register("gamma_sweep", sweep_sql(), ("gamma",) + tuple(c for c in SWEEP_COLS if c in METRIC_DOUBLES))
def q_gamma_sweep(spark, sf_dir):
    return sweep_df(spark, sf_dir).select("pos", "gamma", *SWEEP_COLS)


@register("gamma_sweep_by_lang", sweep_sql(by="lang"),
          ("gamma",) + tuple(c for c in SWEEP_COLS if c in METRIC_DOUBLES))
def q_gamma_sweep_by_lang(spark, sf_dir):
    return sweep_df(spark, sf_dir, by="lang").select("lang", "pos", "gamma", *SWEEP_COLS)


# ----------------------------------------------------------------- F1 - F4, F11, F14
def counters_sql(policy="p1", extra=""):
    lab = "(ground_truth IS NOT NULL AND ground_truth <> '')"
    ok = f"({lab} AND coalesce(correct, FALSE))"
    c = (f"SELECT lang, count(*) AS total_evaluations, "
         f"CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS escalations, "
         f"CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreements, "
         f"CAST(sum(CASE WHEN NOT agree THEN 1 ELSE 0 END) AS BIGINT) AS disagreements, "
         f"CAST(sum(CASE WHEN {ok} THEN 1 ELSE 0 END) AS BIGINT) AS correct_predictions, "
         f"CAST(sum(CASE WHEN {ok} AND escalated THEN 1 ELSE 0 END) AS BIGINT) AS correct_escalations, "
         f"CAST(sum(CASE WHEN {ok} AND NOT escalated THEN 1 ELSE 0 END) AS BIGINT) AS correct_non_escalations, "
         f"count(*) AS verifier_a_calls, count(*) AS verifier_b_calls, "
         f"CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS judge_calls, "
         f"CAST(sum(CASE WHEN {lab} THEN 1 ELSE 0 END) AS BIGINT) AS labelled FROM res GROUP BY lang")
    return O.cascade_ctes(policy=policy) + f",\nc AS ({c})" + extra


COUNTER_COLS = "lang, total_evaluations, escalations, agreements, disagreements, correct_predictions, " \
               "correct_escalations, correct_non_escalations, verifier_a_calls, verifier_b_calls, judge_calls"
RATE_DOUBLES = ("escalation_rate", "disagreement_rate", "agreement_rate", "overall_accuracy", "escalation_accuracy",
                "non_escalation_accuracy", "avg_calls_per_evaluation", "labeled_accuracy")


def rates_sql(policy="p1"):
    correct = "correct_escalations + correct_non_escalations" if policy == "p3" else "correct_predictions"
    d = O._div
    return ", ".join([
        f"{d('escalations', 'total_evaluations')} AS escalation_rate",
        f"{d('disagreements', 'total_evaluations')} AS disagreement_rate",
        f"{d('agreements', 'total_evaluations')} AS agreement_rate",
        f"{d(correct, 'total_evaluations')} AS overall_accuracy",
        f"{d('correct_escalations', 'escalations')} AS escalation_accuracy",
        f"{d('correct_non_escalations', 'total_evaluations - escalations')} AS non_escalation_accuracy",
        "verifier_a_calls + verifier_b_calls + judge_calls AS total_model_calls",
        f"{d('verifier_a_calls + verifier_b_calls + judge_calls', 'total_evaluations')} AS avg_calls_per_evaluation",
        f"{d('correct_predictions', 'labelled')} AS labeled_accuracy"])


@register("counters", with_ctes(counters_sql(), f"SELECT {COUNTER_COLS} FROM c"))
def q_counters(spark, sf_dir):
    return M.counters(results(spark, sf_dir), by="lang")


@register("cascade_metrics", with_ctes(counters_sql(), f"SELECT {COUNTER_COLS}, {rates_sql()} FROM c"), RATE_DOUBLES)
def q_cascade_metrics(spark, sf_dir):
    return M.cascade_metrics(results(spark, sf_dir), by="lang")


@register("cascade_metrics_p3", with_ctes(counters_sql("p3"), f"SELECT {COUNTER_COLS}, {rates_sql('p3')} FROM c"),
          RATE_DOUBLES)
def q_cascade_metrics_p3(spark, sf_dir):
    return M.cascade_metrics(results(spark, sf_dir, policy="p3"), by="lang", policy="p3")


@register("agreement_quality", with_ctes(
    O.cascade_ctes(policy="p2"),
    "SELECT lang, count(*) AS total_evaluations, CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreements, "
    "CAST(sum(CASE WHEN agree AND NOT escalated THEN 1 ELSE 0 END) AS BIGINT) AS high_confidence_agreements, "
    "CAST(sum(CASE WHEN agree AND escalated THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence_agreements, "
    "CASE WHEN sum(CASE WHEN agree THEN 1 ELSE 0 END) > 0 THEN "
    "sum(CASE WHEN agree AND NOT escalated THEN 1 ELSE 0 END) / sum(CASE WHEN agree THEN 1 ELSE 0 END) END "
    "AS high_conf_agreement_rate FROM res GROUP BY lang"), ("high_conf_agreement_rate",))
def q_agreement_quality(spark, sf_dir):
    return M.agreement_quality(results(spark, sf_dir, policy="p2"), by="lang")


HARNESS_COLS = ["accuracy", "escalation_rate", "escalated_accuracy", "non_escalated_accuracy", "false_consensus_rate",
                "disagreement_rate", "avg_calls_per_evaluation", "total_evaluations", "total_escalations",
                "total_agreements", "total_disagreements"]
HARNESS_DOUBLES = ("accuracy", "escalation_rate", "escalated_accuracy", "non_escalated_accuracy",
                   "false_consensus_rate", "disagreement_rate", "avg_calls_per_evaluation")


@register("false_consensus_p2", with_ctes(
    O.cascade_ctes(policy="p2") + f",\ns AS ({O.sums_sql('res', 'lang')})",
    f"SELECT lang, {O.harness_sql()} FROM s"), HARNESS_DOUBLES)
def q_false_consensus_p2(spark, sf_dir):
    return M.harness_metrics(results(spark, sf_dir, policy="p2"), by="lang")


@register("sweep_metrics_p2", with_ctes(
    O.sweep_ctes(GAMMAS, "p2") + f",\ns AS ({O.sums_sql('res', 'pos, gamma_in')})",
    f"SELECT pos, gamma_in AS gamma, {O.harness_sql()} FROM s"), ("gamma",) + HARNESS_DOUBLES)
def q_sweep_metrics_p2(spark, sf_dir):
    r = results(spark, sf_dir, max(GAMMAS), "p2")
    return S.sweep_metrics_p2(r, GAMMAS)


# ----------------------------------------------------------------- F16 - F20, G1 - G7, B15, I1 - I5
@register("class_balance", with_ctes(
    f"claims AS ({O.claims_sql(False)})",
    "SELECT CAST(sum(CASE WHEN ground_truth = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS positive, "
    "CAST(sum(CASE WHEN ground_truth = 'no' THEN 1 ELSE 0 END) AS BIGINT) AS negative, count(*) AS size FROM claims"))
def q_class_balance(spark, sf_dir):
    return M.class_balance(document_claims(spark, sf_dir, with_text=False))


RANGE_COLS = ("gamma", "overall_accuracy", "escalation_rate", "avg_calls_per_evaluation", "false_consensus_rate")


@register("sweep_ranges", sweep_sql(select="SELECT count(*) AS configs, " + ", ".join(
    f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in RANGE_COLS) + " FROM sw"),
    tuple(f"{m}_{c}" for c in RANGE_COLS for m in ("min", "max")))
def q_sweep_ranges(spark, sf_dir):
    return S.sweep_ranges(sweep_df(spark, sf_dir), RANGE_COLS)


SUMMARY_METRICS = ("overall_accuracy", "avg_calls_per_evaluation", "escalation_rate")


@register("summary_stats", sweep_sql(select=" UNION ALL ".join(
    f"SELECT '{c}' AS metric, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"median({c}) AS median, count(*) AS num_evaluations FROM sw" for c in SUMMARY_METRICS)),
    ("mean", "std", "min", "max", "median"))
def q_summary_stats(spark, sf_dir):
    from verdictflow.plans.compare import summary_stats
    return summary_stats(sweep_df(spark, sf_dir), SUMMARY_METRICS)


BEST_COLS = ["pos", "gamma", "overall_accuracy", "escalation_rate", "avg_calls_per_evaluation", "false_consensus_rate"]
BEST_DOUBLES = ("gamma", "overall_accuracy", "escalation_rate", "avg_calls_per_evaluation", "false_consensus_rate")


def best_sql(order, extra_col=""):
    cols = ", ".join(BEST_COLS) + (f", {extra_col}" if extra_col else "")
    return sweep_select(f"SELECT {cols} FROM sw ORDER BY {order}, pos LIMIT 1")


def sweep_select(select):
    return sweep_sql(select=select)


@register("best_accuracy", best_sql("overall_accuracy DESC"), BEST_DOUBLES)
def q_best_accuracy(spark, sf_dir):
    return S.best_accuracy(sweep_df(spark, sf_dir)).select(*BEST_COLS)


@register("best_efficiency", best_sql("overall_accuracy / avg_calls_per_evaluation DESC",
                                      "overall_accuracy / avg_calls_per_evaluation AS efficiency"),
          BEST_DOUBLES + ("efficiency",))
def q_best_efficiency(spark, sf_dir):
    return S.best_efficiency(sweep_df(spark, sf_dir)).select(*BEST_COLS, "efficiency")


@register("lowest_cost", best_sql("avg_calls_per_evaluation ASC"), BEST_DOUBLES)
def q_lowest_cost(spark, sf_dir):
    return S.lowest_cost(sweep_df(spark, sf_dir)).select(*BEST_COLS)


@register("lowest_fcr", best_sql("false_consensus_rate ASC NULLS LAST"), BEST_DOUBLES)
def q_lowest_fcr(spark, sf_dir):
    return S.lowest_fcr(sweep_df(spark, sf_dir)).select(*BEST_COLS)


@register("best_cost_ratio", best_sql("avg_calls_per_evaluation / overall_accuracy ASC",
                                      "avg_calls_per_evaluation / overall_accuracy AS cost_ratio"),
          BEST_DOUBLES + ("cost_ratio",))
def q_best_cost_ratio(spark, sf_dir):
    return S.best_cost_ratio(sweep_df(spark, sf_dir)).select(*BEST_COLS, "cost_ratio")


@register("sweep_high_escalation", sweep_select("SELECT pos, gamma, escalation_rate FROM sw WHERE escalation_rate > 0.3"),
          ("gamma", "escalation_rate"))
def q_sweep_high_escalation(spark, sf_dir):
    return S.sweep_high_escalation(sweep_df(spark, sf_dir)).select("pos", "gamma", "escalation_rate")


@register("sweep_top_accuracy", sweep_select(
    "SELECT pos, gamma, overall_accuracy, avg_calls_per_evaluation, q AS accuracy_quantile FROM sw, "
    "(SELECT quantile_cont(overall_accuracy, 0.8) AS q FROM sw) qq WHERE overall_accuracy > q"),
    ("gamma", "overall_accuracy", "avg_calls_per_evaluation", "accuracy_quantile"))
def q_sweep_top_accuracy(spark, sf_dir):
    return S.sweep_top_accuracy(sweep_df(spark, sf_dir)).select(
        "pos", "gamma", "overall_accuracy", "avg_calls_per_evaluation", "accuracy_quantile")


@register("diminishing_returns", sweep_select(
    "SELECT count(*) AS configs, arg_max(gain, struct_pack(gamma, pos)) AS last_gain, "
    "coalesce(count(*) > 3 AND arg_max(gain, struct_pack(gamma, pos)) < 0.01, FALSE) AS flagged, "
    "CASE WHEN count(*) > 3 AND arg_max(gain, struct_pack(gamma, pos)) < 0.01 "
    "THEN arg_max(prev_gamma, struct_pack(gamma, pos)) END AS beyond_gamma FROM ("
    "SELECT *, overall_accuracy - lag(overall_accuracy) OVER (ORDER BY gamma, pos) AS gain, "
    "lag(gamma) OVER (ORDER BY gamma, pos) AS prev_gamma FROM sw) x"), ("last_gain", "beyond_gamma"))
def q_diminishing_returns(spark, sf_dir):
    return S.diminishing_returns(sweep_df(spark, sf_dir))


@register("gamma_sensitivity", with_ctes(
    O.sweep_ctes(GAMMAS),
    "SELECT pos, gamma_in AS gamma, count(*) AS agreements, "
    "CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS escalated, "
    "sum(CASE WHEN escalated THEN 1 ELSE 0 END) / count(*) AS escalation_rate FROM res WHERE agree "
    "GROUP BY pos, gamma_in"), ("gamma", "escalation_rate"))
def q_gamma_sensitivity(spark, sf_dir):
    return S.gamma_sensitivity(results(spark, sf_dir, max(GAMMAS)), GAMMAS)


@register("tradeoff_series", sweep_select(" UNION ALL ".join(
    f"SELECT '{s}' AS series, pos, gamma, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM sw"
    for s, x, y in [("accuracy_vs_escalation", "escalation_rate", "overall_accuracy"),
                    ("cost_vs_accuracy", "avg_calls_per_evaluation", "overall_accuracy"),
                    ("false_consensus_vs_gamma", "gamma", "false_consensus_rate"),
                    ("escalation_vs_gamma", "gamma", "escalation_rate"),
                    ("disagreement_vs_gamma", "gamma", "disagreement_rate")])), ("gamma", "x", "y"))
def q_tradeoff_series(spark, sf_dir):
    from verdictflow.plans.report import tradeoff_series
    return tradeoff_series(sweep_df(spark, sf_dir))


def _report_sql():
    def row(sec, item, g, v):
        return f"SELECT '{sec}' AS section, '{item}' AS item, CAST({g} AS DOUBLE) AS gamma, CAST({v} AS DOUBLE) AS value"
    ba = "(SELECT gamma, overall_accuracy FROM sw ORDER BY overall_accuracy DESC, pos LIMIT 1)"
    be = ("(SELECT gamma, overall_accuracy, avg_calls_per_evaluation FROM sw "
          "ORDER BY overall_accuracy / avg_calls_per_evaluation DESC, pos LIMIT 1)")
    parts = [
        row("summary", "gamma_values_tested", "NULL", "(SELECT count(*) FROM sw)"),
        row("range", "gamma_min", "NULL", "(SELECT min(gamma) FROM sw)"),
        row("range", "gamma_max", "NULL", "(SELECT max(gamma) FROM sw)"),
        row("range", "accuracy_min", "NULL", "(SELECT min(overall_accuracy) FROM sw)"),
        row("range", "accuracy_max", "NULL", "(SELECT max(overall_accuracy) FROM sw)"),
        row("range", "escalation_min", "NULL", "(SELECT min(escalation_rate) FROM sw)"),
        row("range", "escalation_max", "NULL", "(SELECT max(escalation_rate) FROM sw)"),
        row("range", "cost_min", "NULL", "(SELECT min(avg_calls_per_evaluation) FROM sw)"),
        row("range", "cost_max", "NULL", "(SELECT max(avg_calls_per_evaluation) FROM sw)"),
        row("optimal", "best_accuracy", f"(SELECT gamma FROM {ba})", f"(SELECT overall_accuracy FROM {ba})"),
        row("optimal", "best_efficiency_accuracy", f"(SELECT gamma FROM {be})", f"(SELECT overall_accuracy FROM {be})"),
        row("optimal", "best_efficiency_cost", f"(SELECT gamma FROM {be})",
            f"(SELECT avg_calls_per_evaluation FROM {be})"),
        row("insight", "high_escalation_gamma_min", "NULL", "(SELECT min(gamma) FROM sw WHERE escalation_rate > 0.3)"),
        row("insight", "high_escalation_gamma_max", "NULL", "(SELECT max(gamma) FROM sw WHERE escalation_rate > 0.3)"),
        row("insight", "top_accuracy_min_cost", "NULL",
            "(SELECT min(avg_calls_per_evaluation) FROM sw WHERE overall_accuracy > "
            "(SELECT quantile_cont(overall_accuracy, 0.8) FROM sw))"),
        row("insight", "diminishing_returns_beyond", "NULL",
            "(SELECT CASE WHEN count(*) > 3 AND arg_max(gain, struct_pack(gamma, pos)) < 0.01 THEN "
            "arg_max(prev_gamma, struct_pack(gamma, pos)) END FROM (SELECT *, overall_accuracy - "
            "lag(overall_accuracy) OVER (ORDER BY gamma, pos) AS gain, lag(gamma) OVER (ORDER BY gamma, pos) "
            "AS prev_gamma FROM sw) x)"),
    ]
    return sweep_select("SELECT * FROM (" + " UNION ALL ".join(parts) +
                        ") r WHERE value IS NOT NULL OR section <> 'insight'")


@register("sweep_report", _report_sql(), ("gamma", "value"))
def q_sweep_report(spark, sf_dir):
    from verdictflow.plans.report import sweep_report_rows
    return sweep_report_rows(sweep_df(spark, sf_dir))


def _report_p2_sql():
    def row(sec, item, g, v):
        return f"SELECT '{sec}' AS section, '{item}' AS item, CAST({g} AS DOUBLE) AS gamma, CAST({v} AS DOUBLE) AS value"
    ba = "(SELECT gamma, accuracy FROM sw ORDER BY accuracy DESC, pos LIMIT 1)"
    lc = "(SELECT gamma, avg_calls_per_evaluation FROM sw ORDER BY avg_calls_per_evaluation ASC, pos LIMIT 1)"
    lf = "(SELECT gamma, false_consensus_rate FROM sw ORDER BY false_consensus_rate ASC, pos LIMIT 1)"
    re_ = ("(SELECT gamma, accuracy, avg_calls_per_evaluation, escalation_rate FROM sw "
           "ORDER BY accuracy / avg_calls_per_evaluation DESC, pos LIMIT 1)")
    parts = [
        row("best", "highest_accuracy", f"(SELECT gamma FROM {ba})", f"(SELECT accuracy FROM {ba})"),
        row("best", "lowest_cost", f"(SELECT gamma FROM {lc})", f"(SELECT avg_calls_per_evaluation FROM {lc})"),
        row("best", "lowest_false_consensus", f"(SELECT gamma FROM {lf})", f"(SELECT false_consensus_rate FROM {lf})"),
    ]
    for c, n in [("accuracy", "accuracy"), ("escalation_rate", "escalation"), ("avg_calls_per_evaluation", "cost"),
                 ("false_consensus_rate", "false_consensus")]:
        parts.append(row("range", f"{n}_min", "NULL", f"(SELECT min({c}) FROM sw)"))
        parts.append(row("range", f"{n}_max", "NULL", f"(SELECT max({c}) FROM sw)"))
    for c, n in [("accuracy", "accuracy"), ("avg_calls_per_evaluation", "cost"), ("escalation_rate", "escalation_rate")]:
        parts.append(row("recommended", n, f"(SELECT gamma FROM {re_})", f"(SELECT {c} FROM {re_})"))
    base = O.sweep_ctes(GAMMAS, "p2") + f",\ns AS ({O.sums_sql('res', 'pos, gamma_in')})" + \
        f",\nsw AS (SELECT pos, gamma_in AS gamma, {O.harness_sql()} FROM s)"
    return with_ctes(base, " UNION ALL ".join(parts))


@register("sweep_report_p2", _report_p2_sql(), ("gamma", "value"))
def q_sweep_report_p2(spark, sf_dir):
    from verdictflow.plans.report import sweep_report_rows_p2
    r = results(spark, sf_dir, max(GAMMAS), "p2")
    return sweep_report_rows_p2(S.sweep_metrics_p2(r, GAMMAS))
