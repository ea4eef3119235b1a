"""Cascade metrics as built-in aggregates.

Everything is computed in ONE aggregation pass: first a set of additive sums
(partial aggregation on the map side, so a hot group never reaches a single
task as rows), then the rates as a projection over the sums. The same
``derive_*`` projections are reused by the gamma sweep, which builds the
sums by prefix-summing instead of re-scanning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _i(c: Column) -> Column:
    return F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _n(cond: str) -> Column:
    """Count of rows where the SQL condition holds (one expression, one py4j call)."""
    return F.expr(f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)")


def truth_binary(truth: Column) -> Column:
    """1 if truth == 'yes' else 0 (so an un-normalised 'true' is 0; NULL is 0)."""
    return F.when(truth == "yes", F.lit(1)).otherwise(F.lit(0))


def truth_sql(truth: str) -> str:
    """B6 over rows with an optional truth (SQL): NULL where none is given (NULL or empty, as in B10)."""
    return f"(CASE WHEN {truth} = 'yes' THEN 1 WHEN {truth} <> '' THEN 0 END)"


def row_cost(escalated: Column) -> Column:
    """Model calls of one row."""
    return F.when(escalated, F.lit(3)).otherwise(F.lit(2))


# ------------------------------------------------------------------ sums
SUM_NAMES = ("n", "n_esc", "n_agree", "n_hit", "n_hit_esc", "n_hit_non", "n_calls", "n_tp", "n_fp", "n_fn",
             "n_lab", "n_lab_esc", "n_lab_agree_non")


def evaluation_sums(truth_col: str = "ground_truth") -> list[Column]:
    """Additive per-group sums behind F5-F12 (``calculate_metrics``).

    The truth is optional: counts, escalations and calls are over all rows, hits over labelled ones
    (``n_lab`` and the like are what accuracies divide by).
    """
    gt = truth_sql(f"`{truth_col}`")
    hit, lab = f"final_prediction = {gt}", f"{gt} IS NOT NULL"
    return [
        F.expr("count(1)").alias("n"),
        _n("escalated").alias("n_esc"),
        _n("agree").alias("n_agree"),
        _n(hit).alias("n_hit"),
        _n(f"escalated AND {hit}").alias("n_hit_esc"),
        _n(f"NOT escalated AND {hit}").alias("n_hit_non"),
        F.expr("CAST(sum(CASE WHEN escalated THEN 3 ELSE 2 END) AS BIGINT)").alias("n_calls"),
        _n(f"final_prediction = 1 AND {gt} = 1").alias("n_tp"),
        _n(f"final_prediction = 1 AND {gt} = 0").alias("n_fp"),
        _n(f"final_prediction = 0 AND {gt} = 1").alias("n_fn"),
        _n(lab).alias("n_lab"),
        _n(f"escalated AND {lab}").alias("n_lab_esc"),
        _n(f"agree AND NOT escalated AND {lab}").alias("n_lab_agree_non"),
    ]


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def _d(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def derive_metrics(include_efficiency: bool = True) -> list[Column]:
    """F5-F13 from the sums (``MetricsResult``); undefined ratios are NULL.

    Accuracies, false consensus and the cost of a correct answer are over labelled rows only.
    """
    prec, rec = _d("n_tp", "n_tp + n_fp"), _d("n_tp", "n_tp + n_fn")
    acc, calls = _d("n_hit", "n_lab"), _d("n_calls", "n")
    lab_non, lab_calls = "n_lab - n_lab_esc", "(2 * n_lab + n_lab_esc)"
    cols = [
        ("n", "total_evaluations"), ("n_esc", "escalations"), ("n_agree", "agreements"),
        ("n - n_agree", "disagreements"), ("n_hit", "correct_predictions"),
        (acc, "overall_accuracy"),
        (_d("n_hit_esc", "n_lab_esc"), "escalated_accuracy"),
        (_d("n_hit_non", lab_non), "non_escalated_accuracy"),
        (_d("n_esc", "n"), "escalation_rate"),
        (_d("n - n_agree", "n"), "disagreement_rate"),
        (_d("n_agree", "n"), "agreement_rate"),
        ("n_calls", "total_model_calls"),
        (calls, "avg_calls_per_evaluation"),
        (f"CASE WHEN n_hit > 0 THEN CAST({lab_calls} AS DOUBLE) / CAST(n_hit AS DOUBLE) ELSE double('Infinity') END",
         "cost_per_correct"),
        (_d("(n_lab - n_lab_esc - n_hit_non)", lab_non), "false_consensus_rate"),
        (prec, "precision"), (rec, "recall"),
        (f"CASE WHEN ({prec}) IS NOT NULL AND ({rec}) IS NOT NULL AND ({prec}) + ({rec}) > 0 "
         f"THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) END", "f1_score"),
    ]
    if include_efficiency:
        cols.append((f"CASE WHEN ({calls}) > 0 THEN ({acc}) / ({calls}) ELSE 0.0D END", "efficiency"))
    return [F.expr(e).alias(n) for e, n in cols]


#: The fields of ``MetricsResult``.
RESULT_FIELDS = ("total_evaluations", "escalations", "agreements", "disagreements", "correct_predictions",
                 "overall_accuracy", "escalated_accuracy", "non_escalated_accuracy", "escalation_rate",
                 "disagreement_rate", "agreement_rate", "total_model_calls", "avg_calls_per_evaluation",
                 "cost_per_correct", "false_consensus_rate", "precision", "recall", "f1_score")


def metrics_json() -> Column:
    """All metric fields as JSON, without the undefined ones."""
    return F.to_json(F.struct(*RESULT_FIELDS))


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def evaluation_metrics(results: DataFrame, by: str | Sequence[str] | None = None,
                       truth_col: str = "ground_truth") -> DataFrame:
    """``calculate_metrics`` per group (one row if ``by`` is None)."""
    keys = _by(by)
    sums = results.groupBy(*keys).agg(*evaluation_sums(truth_col))
    return sums.select(*keys, *derive_metrics())


def harness_metrics_from_sums() -> list[Column]:
    """the P2 harness columns (false consensus is 0 when undefined)."""
    cols = [
        (_d("n_hit", "n_lab"), "accuracy"), (_d("n_esc", "n"), "escalation_rate"),
        (_d("n_hit_esc", "n_lab_esc"), "escalated_accuracy"),
        (_d("n_hit_non", "n_lab - n_lab_esc"), "non_escalated_accuracy"),
        (f"coalesce({_d('(n_lab_agree_non - n_hit_non)', 'n_lab_agree_non')}, 0.0D)", "false_consensus_rate"),
        (_d("n - n_agree", "n"), "disagreement_rate"), (_d("n_calls", "n"), "avg_calls_per_evaluation"),
        ("n", "total_evaluations"), ("n_esc", "total_escalations"), ("n_agree", "total_agreements"),
        ("n - n_agree", "total_disagreements"),
    ]
    return [F.expr(e).alias(n) for e, n in cols]


# ------------------------------------------------------------------ F1 - F4
def counter_columns(truth_col: str = "ground_truth") -> list[Column]:
    """the reference's running counters, derived from rows."""
    esc = F.col("escalated")
    labelled = F.col(truth_col).isNotNull() & (F.col(truth_col) != "")
    ok = labelled & F.coalesce(F.col("correct"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total_evaluations"),
        _i(esc).alias("escalations"),
        _i(F.col("agree")).alias("agreements"),
        _i(~F.col("agree")).alias("disagreements"),
        _i(ok).alias("correct_predictions"),
        _i(ok & esc).alias("correct_escalations"),
        _i(ok & ~esc).alias("correct_non_escalations"),
        F.count(F.lit(1)).alias("verifier_a_calls"),
        F.count(F.lit(1)).alias("verifier_b_calls"),
        _i(esc).alias("judge_calls"),
        _i(labelled).alias("labelled"),
    ]


def counters(results: DataFrame, by=None, truth_col: str = "ground_truth") -> DataFrame:
    """F1 per group."""
    keys = _by(by)
    return results.groupBy(*keys).agg(*counter_columns(truth_col)).drop("labelled")


def rates_from_counters(policy: str = "p1") -> list[Column]:
    """F2 (P1) / F4 (P3) rates over the counters; absent keys become NULL."""
    n, esc = F.col("total_evaluations"), F.col("escalations")
    non = n - esc
    calls = F.col("verifier_a_calls") + F.col("verifier_b_calls") + F.col("judge_calls")
    if policy == "p3":
        correct = F.col("correct_escalations") + F.col("correct_non_escalations")
    else:
        correct = F.col("correct_predictions")
    return [
        _div(esc, n).alias("escalation_rate"),
        _div(F.col("disagreements"), n).alias("disagreement_rate"),
        _div(F.col("agreements"), n).alias("agreement_rate"),
        _div(correct, n).alias("overall_accuracy"),
        _div(F.col("correct_escalations"), esc).alias("escalation_accuracy"),
        _div(F.col("correct_non_escalations"), non).alias("non_escalation_accuracy"),
        calls.alias("total_model_calls"),
        _div(calls, n).alias("avg_calls_per_evaluation"),
    ]


def cascade_metrics(results: DataFrame, by=None, truth_col: str = "ground_truth", policy: str = "p1") -> DataFrame:
    """``get_metrics`` - counters plus rates (accuracy divides by ALL rows, Q8)
    and ``labeled_accuracy`` (divides by labelled rows only)."""
    keys = _by(by)
    c = results.groupBy(*keys).agg(*counter_columns(truth_col))
    return c.select(*keys, *[x for x in c.columns if x not in keys and x != "labelled"],
                    *rates_from_counters(policy),
                    _div(F.col("correct_predictions"), F.col("labelled")).alias("labeled_accuracy"))


def agreement_quality(results: DataFrame, by=None) -> DataFrame:
    """high/low confidence agreements (P2 ``get_metrics`` extras)."""
    keys = _by(by)
    agree, esc = F.col("agree"), F.col("escalated")
    s = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_evaluations"), _i(agree).alias("agreements"),
                                   _i(agree & ~esc).alias("high_confidence_agreements"),
                                   _i(agree & esc).alias("low_confidence_agreements"))
    return s.withColumn("high_conf_agreement_rate", _div(F.col("high_confidence_agreements"), F.col("agreements")))


# ------------------------------------------------------------------ F16, F21 - F25
def class_balance(claims: DataFrame, truth_col: str = "ground_truth") -> DataFrame:
    """F16: one row with positive / negative counts."""
    t = F.col(truth_col)
    return claims.agg(_i(t == "yes").alias("positive"), _i(t == "no").alias("negative"),
                      F.count(F.lit(1)).alias("size"))


def answered() -> Column:
    """None of the row's answers failed."""
    return F.col("a.error").isNull() & F.col("b.error").isNull() & \
        (F.col("judge").isNull() | F.col("judge.error").isNull())


def successful(results: DataFrame) -> DataFrame:
    """Rows none of whose answers failed."""
    return results.filter(answered())


def timing_confidence(results: DataFrame, by=None, elapsed_col: str | None = None) -> DataFrame:
    """mean time and confidences over successful rows."""
    keys = _by(by)
    aggs = [F.count(F.lit(1)).alias("successful"), F.avg("a.confidence").alias("avg_a_confidence"),
            F.avg("b.confidence").alias("avg_b_confidence")]
    if elapsed_col:
        aggs.append(F.avg(elapsed_col).alias("avg_time_ms"))
    s = successful(results).groupBy(*keys).agg(*aggs)
    return s.withColumn("avg_confidence", (F.col("avg_a_confidence") + F.col("avg_b_confidence")) / 2)


def disagreement_analysis(results: DataFrame, by=None) -> DataFrame:
    """agreements / disagreements over successful rows."""
    keys = _by(by)
    s = successful(results).groupBy(*keys).agg(_i(F.col("agree")).alias("agreements"),
                                                _i(~F.col("agree")).alias("disagreements"),
                                                F.count(F.lit(1)).alias("successful"))
    return s.withColumn("disagreement_rate", _div(F.col("disagreements"), F.col("successful")))


def macro_escalation(results: DataFrame, category_col: str) -> DataFrame:
    """per-category escalation rate and their unweighted mean (one shuffle, tiny second stage)."""
    per = results.groupBy(category_col).agg(F.avg(F.col("escalated").cast("int")).alias("escalation_rate"))
    return per.agg(F.avg("escalation_rate").alias("macro_escalation_rate"),
                   F.count(F.lit(1)).alias("categories"))


def by_type_summary(results: DataFrame, type_col: str = "type", truth_col: str = "ground_truth") -> DataFrame:
    """accuracy where labelled, escalation and disagreement everywhere, per record type."""
    labelled = F.col(truth_col).isNotNull() & (F.col(truth_col) != "")
    return results.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("claims"),
        _i(labelled).alias("labelled"),
        F.avg(F.when(labelled, F.col("correct").cast("int"))).alias("accuracy"),
        F.avg(F.col("escalated").cast("int")).alias("escalation_rate"),
        F.avg((~F.col("agree")).cast("int")).alias("disagreement_rate"))


def harness_metrics(results: DataFrame, by=None, truth_col: str = "ground_truth") -> DataFrame:
    """F11 / F14 at one gamma: the P2 harness columns per group."""
    keys = _by(by)
    return results.groupBy(*keys).agg(*evaluation_sums(truth_col)).select(*keys, *harness_metrics_from_sums())
