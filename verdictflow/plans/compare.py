"""Comparing configurations and runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.operators import metrics as M


def summary_stats(configs: DataFrame, cols: Sequence[str] = ("overall_accuracy", "avg_calls_per_evaluation",
                                                             "escalation_rate"), by=None) -> DataFrame:
    """mean / population std / min / max / median of each metric over configurations."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    long = configs.unpivot(keys or None, list(cols), "metric", "value") if keys else \
        configs.unpivot([], list(cols), "metric", "value")
    v = F.col("value")
    return long.groupBy(*keys, "metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.median(v).alias("median"), F.count(F.lit(1)).alias("num_evaluations"))


def paired_runs(results_a: DataFrame, results_b: DataFrame, id_col: str = "claim_id",
                truth_col: str = "ground_truth", keys: Sequence[str] = ()) -> DataFrame:
    """The two runs' outcomes on the same claims (inner equi-join on the key), with the first run's ``keys``.

    Claims without a truth have no outcome and are left out."""
    given = F.col(truth_col).isNotNull() & (F.col(truth_col) != "")

    def side(r, s, *more):
        return r.filter(given).select(F.col(id_col), F.col(truth_col).alias(f"truth_{s}"),
                        F.col("final_prediction").alias(f"final_{s}"),
                        (F.col("final_prediction") == M.truth_binary(F.col(truth_col))).cast("int").alias(f"hit_{s}"), *more)
    j = side(results_a, "a", *keys).join(side(results_b, "b"), id_col, "inner")
    return j.select(id_col, F.col("truth_a").alias(truth_col), "final_a", "final_b", "hit_a", "hit_b",
                    (F.col("hit_a") - F.col("hit_b")).alias("diff"), *keys)


# The tail of Student's t is an integral over (t, infinity), taken by the double exponential rule: at
# u = t + exp(pi/2 sinh x) for x in equal steps, which suits tails that fall slowly (few degrees of
# freedom) and quickly (many) alike. The gamma functions enter as the ratio g(z + 1/2) / g(z), from its
# asymptotic series at z + SHIFT and the recurrence down to z.
STEPS, STEP, SHIFT = 160, 0.03125, 16
RATIO_SERIES = ((1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432))  # power of 1/z, factor


def student_t_tail_sql(t: str, df: str) -> str:
    """The two-sided tail beyond ``t`` of Student's t with ``df`` > 0 degrees of freedom, as one SQL expression (NULL for NULL)."""
    z = f"({df} / 2 + {SHIFT})"
    series = " + ".join(f"({factor!r}D) / pow({z}, {power})" for power, factor in RATIO_SERIES)
    down = f"aggregate(sequence(0, {SHIFT - 1}), 0D, (s, i) -> s + ln(({df} / 2 + i + 0.5D) / ({df} / 2 + i)))"
    ratio = f"(ln({z}) / 2 + {series} - {down})"  # of the logarithms
    away = f"exp(pi() / 2 * sinh(k * {STEP!r}D))"
    density = f"exp({ratio} - ({df} + 1) / 2 * log1p(pow(abs({t}) + {away}, 2) / {df})) / sqrt({df} * pi())"
    total = (f"aggregate(sequence(-{STEPS}, {STEPS}), 0D, "
             f"(s, k) -> s + {density} * {away} * pi() / 2 * cosh(k * {STEP!r}D) * {STEP!r}D)")
    return f"CASE WHEN {df} > 0 AND {t} IS NOT NULL THEN least(1D, 2 * {total}) END"


def student_t_two_sided_p(t: float, df: float) -> float:
    """The same integral for one value, outside Spark; NaN where it is undefined."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    z = df / 2 + SHIFT
    log_c = (math.log(z) / 2 + sum(factor / z ** power for power, factor in RATIO_SERIES) - math.log(df * math.pi) / 2
             - sum(math.log((df / 2 + i + 0.5) / (df / 2 + i)) for i in range(SHIFT)))
    total = 0.0
    for k in range(-STEPS, STEPS + 1):
        away = math.exp(math.pi / 2 * math.sinh(k * STEP))
        log_f = log_c - (df + 1) / 2 * math.log1p((abs(t) + away) ** 2 / df)
        total += math.exp(log_f) * away * math.pi / 2 * math.cosh(k * STEP) * STEP
    return min(1.0, 2 * total)


def paired_ttest(results_a: DataFrame, results_b: DataFrame, id_col: str = "claim_id",
                 truth_col: str = "ground_truth", by=None, with_p: bool = True) -> DataFrame:
    """paired t-test and Cohen's d of per-claim correctness of two runs.

    All moments come from one aggregation; the Student-t tail is a fold over the columns of its result.
    t uses the sample std of the differences, d the population std (0 if that is 0).
    """
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    p = paired_runs(results_a, results_b, id_col, truth_col, keys)
    s = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("hit_a").alias("mean_accuracy_a"),
                             F.avg("hit_b").alias("mean_accuracy_b"), F.avg("diff").alias("mean_diff"),
                             F.stddev_samp("diff").alias("sd_samp"), F.stddev_pop("diff").alias("sd_pop"))
    t = F.when(F.col("sd_samp") > 0, F.col("mean_diff") / (F.col("sd_samp") / F.sqrt(F.col("n"))))
    out = s.select(*keys, "n", "mean_accuracy_a", "mean_accuracy_b",
                   (F.col("mean_accuracy_a") - F.col("mean_accuracy_b")).alias("accuracy_difference"),
                   t.alias("t_statistic"),
                   F.when(F.col("sd_pop") > 0, F.col("mean_diff") / F.col("sd_pop")).otherwise(F.lit(0.0))
                   .alias("cohens_d"))
    if with_p:
        out = out.withColumn("p_value", F.expr(student_t_tail_sql("t_statistic", "CAST(n - 1 AS DOUBLE)")))
        out = out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    return out


def compare_configs(results: DataFrame, config_col: str = "config", order_col: str | None = None,
                    truth_col: str = "ground_truth") -> DataFrame:
    """Accuracy, cost, efficiency and escalation per configuration, plus the
    winners (first configuration in ``order_col`` order wins ties)."""
    m = M.evaluation_metrics(results, by=[config_col] + ([order_col] if order_col else []), truth_col=truth_col)
    m = m.select(config_col, *([order_col] if order_col else []), "overall_accuracy", "avg_calls_per_evaluation",
                 "efficiency", "escalation_rate")
    order = F.col(order_col) if order_col else F.col(config_col)
    first = -order if order_col else order  # max_by: the first configuration wins ties
    w = Window.partitionBy(F.lit(0))  # the per-configuration table is tiny (one row per config)
    acc = F.max_by(F.col(config_col), F.struct(F.col("overall_accuracy"), first)).over(w)
    eff = F.max_by(F.col(config_col), F.struct(F.col("efficiency"), first)).over(w)
    cost = F.min_by(F.col(config_col), F.struct(F.col("avg_calls_per_evaluation"), order)).over(w)
    return m.select(*m.columns, (F.col(config_col) == acc).alias("best_accuracy"),
                    (F.col(config_col) == eff).alias("best_efficiency"),
                    (F.col(config_col) == cost).alias("lowest_cost"))
