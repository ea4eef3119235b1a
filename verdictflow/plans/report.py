"""Reports over a sweep.

Reports are DataFrames of ``(section, item, gamma, value)`` rows computed with
aggregates over the sweep (a handful of rows per group); only the final text
rendering collects them, and that is at most a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.plans import sweep as S

REPORT_SCHEMA = "section string, item string, gamma double, value double"


def tradeoff_series(sweep: DataFrame, accuracy_col: str = "overall_accuracy") -> DataFrame:
    """I4: the data behind the four trade-off charts, tidy ``(series, pos, gamma, x, y)``."""
    series = (("accuracy_vs_escalation", "escalation_rate", accuracy_col),
              ("cost_vs_accuracy", "avg_calls_per_evaluation", accuracy_col),
              ("false_consensus_vs_gamma", "gamma", "false_consensus_rate"),
              ("escalation_vs_gamma", "gamma", "escalation_rate"), ("disagreement_vs_gamma", "gamma", "disagreement_rate"))
    points = F.array(*[F.struct(F.lit(name).alias("series"), F.col("pos"), F.col("gamma"), F.col(x).cast("double").alias("x"),
                                F.col(y).cast("double").alias("y")) for name, x, y in series])
    return sweep.select(F.inline(points))  # the sweep is computed once


def _rows(df: DataFrame, spec) -> DataFrame:
    """One-row DataFrame ``df`` -> rows (section, item, gamma, value) per (section, item, gamma_col, value_col)."""
    arr = F.array(*[F.struct(F.lit(sec).alias("section"), F.lit(item).alias("item"),
                             (F.col(g).cast("double") if g else F.lit(None).cast("double")).alias("gamma"),
                             F.col(v).cast("double").alias("value")) for sec, item, g, v in spec])
    return df.select(F.inline(arr))


def sweep_report_rows(sweep: DataFrame, accuracy_col: str = "overall_accuracy",
                      high_escalation: float = 0.3, top_quantile: float = 0.8) -> DataFrame:
    """Ranges, best configurations and the three insights of the P1 report."""
    eff = F.col(accuracy_col) / F.col("avg_calls_per_evaluation")
    first_max = lambda m: F.struct(m, -F.col("pos"))  # noqa: E731 - first gamma wins ties
    hi = F.col("escalation_rate") > high_escalation
    qv = F.percentile(F.col(accuracy_col), F.lit(top_quantile))
    base = sweep.withColumn("__q", qv.over(Window.partitionBy(F.lit(0))))
    w_order = Window.partitionBy(F.lit(0)).orderBy("gamma", "pos")
    base = base.withColumn("__gain", F.col(accuracy_col) - F.lag(accuracy_col).over(w_order)) \
               .withColumn("__prev_gamma", F.lag("gamma").over(w_order))
    last = F.max_by(F.struct(F.col("__gain").alias("g"), F.col("__prev_gamma").alias("p")), F.struct("gamma", "pos"))
    one = base.agg(
        F.count(F.lit(1)).cast("double").alias("configs"),
        F.min("gamma").alias("gmin"), F.max("gamma").alias("gmax"),
        F.min(accuracy_col).alias("amin"), F.max(accuracy_col).alias("amax"),
        F.min("escalation_rate").alias("emin"), F.max("escalation_rate").alias("emax"),
        F.min("avg_calls_per_evaluation").alias("cmin"), F.max("avg_calls_per_evaluation").alias("cmax"),
        F.max_by(F.struct(F.col("gamma").alias("g"), F.col(accuracy_col).alias("a")), first_max(F.col(accuracy_col)))
        .alias("ba"),
        F.max_by(F.struct(F.col("gamma").alias("g"), F.col(accuracy_col).alias("a"),
                          F.col("avg_calls_per_evaluation").alias("c")), first_max(eff)).alias("be"),
        F.min(F.when(hi, F.col("gamma"))).alias("hi_min"), F.max(F.when(hi, F.col("gamma"))).alias("hi_max"),
        F.min(F.when(F.col(accuracy_col) > F.col("__q"), F.col("avg_calls_per_evaluation"))).alias("top_cost"),
        last.alias("l"),
    )
    one = one.select("*", F.col("ba.g").alias("ba_g"), F.col("ba.a").alias("ba_a"), F.col("be.g").alias("be_g"),
                     F.col("be.a").alias("be_a"), F.col("be.c").alias("be_c"),
                     F.when((F.col("configs") > 3) & (F.col("l.g") < 0.01), F.col("l.p")).alias("dim"))
    spec = [
        ("summary", "gamma_values_tested", None, "configs"),
        ("range", "gamma_min", None, "gmin"), ("range", "gamma_max", None, "gmax"),
        ("range", "accuracy_min", None, "amin"), ("range", "accuracy_max", None, "amax"),
        ("range", "escalation_min", None, "emin"), ("range", "escalation_max", None, "emax"),
        ("range", "cost_min", None, "cmin"), ("range", "cost_max", None, "cmax"),
        ("optimal", "best_accuracy", "ba_g", "ba_a"),
        ("optimal", "best_efficiency_accuracy", "be_g", "be_a"),
        ("optimal", "best_efficiency_cost", "be_g", "be_c"),
        ("insight", "high_escalation_gamma_min", None, "hi_min"),
        ("insight", "high_escalation_gamma_max", None, "hi_max"),
        ("insight", "top_accuracy_min_cost", None, "top_cost"),
        ("insight", "diminishing_returns_beyond", None, "dim"),
    ]
    return _rows(one, spec).filter(F.col("value").isNotNull() | (F.col("section") != "insight"))


def sweep_report_rows_p2(sweep: DataFrame) -> DataFrame:
    """The P2 harness report: best accuracy / cost / false consensus, ranges, recommendation."""
    acc = F.col("accuracy")
    eff = acc / F.col("avg_calls_per_evaluation")
    fm = lambda m: F.struct(m, -F.col("pos"))
    fn = lambda m: F.struct(m, F.col("pos"))
    pick = lambda *c: F.struct(*[F.col(x).alias(x) for x in c])
    one = sweep.agg(
        F.max_by(pick("gamma", "accuracy"), fm(acc)).alias("ba"),
        F.min_by(pick("gamma", "avg_calls_per_evaluation"), fn(F.col("avg_calls_per_evaluation"))).alias("lc"),
        F.min_by(pick("gamma", "false_consensus_rate"), fn(F.col("false_consensus_rate"))).alias("lf"),
        F.min("accuracy").alias("amin"), F.max("accuracy").alias("amax"),
        F.min("escalation_rate").alias("emin"), F.max("escalation_rate").alias("emax"),
        F.min("avg_calls_per_evaluation").alias("cmin"), F.max("avg_calls_per_evaluation").alias("cmax"),
        F.min("false_consensus_rate").alias("fmin"), F.max("false_consensus_rate").alias("fmax"),
        F.max_by(pick("gamma", "accuracy", "avg_calls_per_evaluation", "escalation_rate"), fm(eff)).alias("re"),
    )
    one = one.select("*", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s, c in
                            [("ba", "gamma"), ("ba", "accuracy"), ("lc", "gamma"), ("lc", "avg_calls_per_evaluation"),
                             ("lf", "gamma"), ("lf", "false_consensus_rate"), ("re", "gamma"), ("re", "accuracy"),
                             ("re", "avg_calls_per_evaluation"), ("re", "escalation_rate")]])
    spec = [
        ("best", "highest_accuracy", "ba_gamma", "ba_accuracy"),
        ("best", "lowest_cost", "lc_gamma", "lc_avg_calls_per_evaluation"),
        ("best", "lowest_false_consensus", "lf_gamma", "lf_false_consensus_rate"),
        ("range", "accuracy_min", None, "amin"), ("range", "accuracy_max", None, "amax"),
        ("range", "escalation_min", None, "emin"), ("range", "escalation_max", None, "emax"),
        ("range", "cost_min", None, "cmin"), ("range", "cost_max", None, "cmax"),
        ("range", "false_consensus_min", None, "fmin"), ("range", "false_consensus_max", None, "fmax"),
        ("recommended", "accuracy", "re_gamma", "re_accuracy"),
        ("recommended", "cost", "re_gamma", "re_avg_calls_per_evaluation"),
        ("recommended", "escalation_rate", "re_gamma", "re_escalation_rate"),
    ]
    return _rows(one, spec)


def render_report(rows: DataFrame, title: str = "CASCADE EVALUATION REPORT") -> str:
    """Text form of report rows (the rows of one report, read one partition at a time)."""
    got = rows.toLocalIterator()
    lines = ["=" * 80, title, "=" * 80]
    for r in got:
        v = r["value"]
        if v is None:
            continue
        pct = any(k in r["item"] for k in ("accuracy", "escalation", "false_consensus"))
        val = f"{v:.1%}" if pct else (f"{v:.2f}" if isinstance(v, float) else str(v))
        g = f" (gamma={r['gamma']:.2f})" if r["gamma"] is not None else ""
        lines.append(f"[{r['section']}] {r['item']}: {val}{g}")
    lines.append("=" * 80)
    return "\n".join(lines)


def ablation(claims: DataFrame, verifier_a, verifier_b, judge, gammas=S.DEFAULT_GAMMAS, policy: str = "p1",
             truth_col: str = "ground_truth", **kw) -> DataFrame:
    """Sweep + the three optimal configurations + dataset size and balance, one row per config kind."""
    r = S.sweep_results(claims, verifier_a, verifier_b, judge, gammas, policy, truth_col=truth_col, **kw)
    sw = S.gamma_sweep(r, gammas, truth_col=truth_col, policy=policy)
    eff = F.col("overall_accuracy") / F.col("avg_calls_per_evaluation")
    # dataset size and balance ride along in every sweep row (summed in the same scan): no extra join
    cols = ["pos", "gamma", "overall_accuracy", "escalation_rate", "avg_calls_per_evaluation", "efficiency",
            "positive", "negative", F.col("total_evaluations").alias("size")]
    return (S.best_accuracy(sw).select(F.lit("best_accuracy").alias("config"), *cols)
            .unionByName(S.best_row(sw, eff, "max").select(F.lit("best_efficiency").alias("config"), *cols))
            .unionByName(S.lowest_cost(sw).select(F.lit("lowest_cost").alias("config"), *cols)))
