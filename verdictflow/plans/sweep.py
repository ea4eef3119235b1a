"""Gamma sweep and best-configuration selection.

The reference re-runs every model call once per gamma. Here the models run
once: the cascade is evaluated at ``max(gammas)``, which asks the judge about
every row that *any* gamma of the sweep escalates (escalation only grows with
gamma). The per-gamma metrics then come from a single scan:

1. each row gets a bucket ``k`` = how many sweep gammas are <= its min
   confidence (0 for disagreements and failed rows); the row is escalated
   exactly for the sorted gammas with index >= k;
2. one partial aggregation of additive sums by ``(group, k)`` - at most
   ``len(gammas) + 1`` rows per group and task leave the map side;
3. a window prefix-sum over ``k`` on that tiny result gives every gamma's
   sums; ``metrics.derive_metrics`` turns them into rates.

No cross join, no per-gamma copy of the data: the cost of a 7-gamma sweep is
one scan plus a few hundred rows, independent of the number of gammas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.parsing import ident
from verdictflow.operators import metrics as M

DEFAULT_GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95)


def _check_gammas(gammas: Sequence[float]) -> list[float]:
    gs = [float(g) for g in gammas]
    if not gs:
        raise ValueError("gamma list is empty")
    for g in gs:
        if not 0.0 <= g <= 1.0:
            raise ValueError("gamma must be between 0 and 1")
    return gs


def _keys(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def escalation_bucket(sorted_gammas: Sequence[float], policy: str = "p1") -> Column:
    """k = number of sweep gammas <= min confidence; 0 when always escalated."""
    always = ~F.col("agree") | (F.col("reason") == "error")
    if policy == "p3":
        return F.when(always, F.lit(0)).otherwise(F.lit(len(sorted_gammas)))
    gammas = ", ".join(f"{float(g)!r}D" for g in sorted_gammas)
    return F.when(always, F.lit(0)).otherwise(F.expr(f"size(filter(array({gammas}), g -> g <= min_confidence))"))


def _bucket_sums(results: DataFrame, sorted_gammas, keys, truth_col, policy, mask: str | None = None) -> DataFrame:
    """Additive sums per (group, bucket). ``mask`` (SQL) restricts the rows that count.

    The restriction is a factor inside the sums, not a Filter: a filter would be
    pushed down through the parser projections and inline them into its
    condition, which costs seconds of planning for nothing.
    """
    gt = M.truth_sql(ident(truth_col))  # NULL without a truth: such a row counts, but never as a hit or a miss
    pe = "CASE WHEN reason = 'error' THEN 0 ELSE judge.prediction END"  # outcome when escalated
    pc = "a.prediction"                                                 # outcome on consensus
    m = f" AND ({mask})" if mask else ""

    def i(cond):
        return F.expr(f"CAST(sum(CASE WHEN ({cond}){m} THEN 1 ELSE 0 END) AS BIGINT)")

    return (results
            .withColumns({"__k": escalation_bucket(sorted_gammas, policy), "__gt": F.expr(gt), "__pe": F.expr(pe),
                          "__pc": F.expr(pc)})
            .groupBy(*keys, "__k")
            .agg(i("TRUE").alias("s_n"), i("agree").alias("s_agree"),
                 i(f"{ident(truth_col)} = 'yes'").alias("s_pos"), i(f"{ident(truth_col)} = 'no'").alias("s_neg"),
                 i("__gt IS NOT NULL").alias("s_lab"), i("agree AND __gt IS NOT NULL").alias("s_lab_agree"),
                 i("__pe = __gt").alias("e_hit"), i("__pc = __gt").alias("c_hit"),
                 i("__pe = 1 AND __gt = 1").alias("e_tp"), i("__pe = 1 AND __gt = 0").alias("e_fp"),
                 i("__pe = 0 AND __gt = 1").alias("e_fn"),
                 i("__pc = 1 AND __gt = 1").alias("c_tp"), i("__pc = 1 AND __gt = 0").alias("c_fp"),
                 i("__pc = 0 AND __gt = 1").alias("c_fn")))


_SUMS = ("s_n", "s_agree", "s_pos", "s_neg", "s_lab", "s_lab_agree", "e_hit", "c_hit", "e_tp", "e_fp", "e_fn", "c_tp", "c_fp", "c_fn")


def sweep_sums(results: DataFrame, gammas: Sequence[float] = DEFAULT_GAMMAS, by=None,
               truth_col: str = "ground_truth", policy: str = "p1", mask: str | None = None) -> DataFrame:
    """Per (group, gamma position) additive sums, in the layout of ``metrics.evaluation_sums``."""
    gs = _check_gammas(gammas)
    keys = _keys(by)
    sorted_gs = sorted(set(gs))
    index = {g: i for i, g in enumerate(sorted_gs)}
    buckets = _bucket_sums(results, sorted_gs, keys, truth_col, policy, mask)

    # spine: one row per (group, requested gamma) carrying zero sums, placed after bucket k == i
    spine_arr = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(g).alias("gamma"), F.lit(index[g]).alias("i"))
                          for p, g in enumerate(gs)])
    groups = buckets.select(*keys).distinct() if keys else buckets.sparkSession.range(1).select()
    spine = (groups.select(*keys, F.explode(spine_arr).alias("s"))
             .select(*keys, F.col("s.i").alias("__k"), F.lit(1).alias("__kind"), F.col("s.pos").alias("pos"),
                     F.col("s.gamma").alias("gamma"), *[F.lit(0).cast("bigint").alias(c) for c in _SUMS]))
    data = buckets.select(*keys, "__k", F.lit(0).alias("__kind"), F.lit(None).cast("int").alias("pos"),
                          F.lit(None).cast("double").alias("gamma"), *_SUMS)
    u = data.unionByName(spine)
    part = [F.col(k) for k in keys] if keys else [F.lit(0)]
    w_cum = Window.partitionBy(*part).orderBy("__k", "__kind").rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
    w_all = Window.partitionBy(*part)
    cum = {c: F.sum(c).over(w_cum) for c in _SUMS}
    tot = {c: F.sum(c).over(w_all) for c in _SUMS}
    esc = cum["s_n"]
    out = u.select(
        *keys, "__kind", "pos", "gamma",
        tot["s_n"].alias("n"),
        esc.alias("n_esc"),
        tot["s_agree"].alias("n_agree"),
        (cum["e_hit"] + tot["c_hit"] - cum["c_hit"]).alias("n_hit"),
        cum["e_hit"].alias("n_hit_esc"),
        (tot["c_hit"] - cum["c_hit"]).alias("n_hit_non"),
        (3 * esc + 2 * (tot["s_n"] - esc)).alias("n_calls"),
        (cum["e_tp"] + tot["c_tp"] - cum["c_tp"]).alias("n_tp"),
        (cum["e_fp"] + tot["c_fp"] - cum["c_fp"]).alias("n_fp"),
        (cum["e_fn"] + tot["c_fn"] - cum["c_fn"]).alias("n_fn"),
        tot["s_lab"].alias("n_lab"),
        cum["s_lab"].alias("n_lab_esc"),
        (tot["s_lab_agree"] - cum["s_lab_agree"]).alias("n_lab_agree_non"),
        tot["s_pos"].alias("positive"),
        tot["s_neg"].alias("negative"),
    )
    return out.filter(F.col("__kind") == 1).drop("__kind")


def gamma_sweep(results: DataFrame, gammas: Sequence[float] = DEFAULT_GAMMAS, by=None,
                truth_col: str = "ground_truth", policy: str = "p1") -> DataFrame:
    """all ``calculate_metrics`` columns per gamma (``pos`` = order the gammas were given).

    ``results`` must come from ``cascade(..., gamma=max(gammas))`` so that the
    judge answered every row some gamma escalates (see :func:`sweep_results`).
    """
    keys = _keys(by)
    s = sweep_sums(with_judge_checked(results, gammas, policy), gammas, by, truth_col, policy)
    return s.select(*keys, "pos", "gamma", *M.derive_metrics(), "positive", "negative")


def sweep_metrics_p2(results: DataFrame, gammas: Sequence[float] = DEFAULT_GAMMAS, by=None,
                     truth_col: str = "ground_truth") -> DataFrame:
    """the P2 harness's 11 columns per gamma (single evaluation, quirk Q7)."""
    keys = _keys(by)
    s = sweep_sums(with_judge_checked(results, gammas, "p2"), gammas, by, truth_col, "p2")
    return s.select(*keys, "pos", "gamma", *M.harness_metrics_from_sums())


def with_judge_checked(results: DataFrame, gammas: Sequence[float], policy: str = "p1") -> DataFrame:
    """Fails on rows that some gamma escalates but whose cascade, run at a lower gamma, never asked
    the judge: without its answer every metric of that gamma would be wrong."""
    if policy == "p3" or "judge" not in results.columns:
        return results
    asked = F.col("judge").isNotNull() | (F.col("reason") == "error")
    escalated = ~F.col("agree") | (F.col("min_confidence") < float(max(gammas)))
    message = "the judge was not asked about a row that the sweep escalates; run the cascade at the largest gamma"
    return results.filter(F.when(escalated & ~asked, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def sweep_results(claims: DataFrame, verifier_a, verifier_b, judge, gammas: Sequence[float] = DEFAULT_GAMMAS,
                  policy: str = "p1", **kw) -> DataFrame:
    """Run the models once for a whole sweep (cascade at the largest gamma)."""
    from verdictflow.operators.cascade import cascade
    from verdictflow.operators.verifiers import ModelVerifier
    gs = _check_gammas(gammas)
    if "materialize" not in kw:  # model answers are costly and non-deterministic: write them once
        kw["materialize"] = any(isinstance(getattr(v, "inner", v), ModelVerifier) for v in (verifier_a, verifier_b, judge))
    return cascade(claims, verifier_a, verifier_b, judge, max(gs), policy, **kw)


def gamma_decisions(results: DataFrame, gammas: Sequence[float] = DEFAULT_GAMMAS, policy: str = "p1",
                    truth_col: str = "ground_truth", keep: Sequence[str] = ("claim_id",)) -> DataFrame:
    """The per-(claim, gamma) decision table, for users who want the rows.

    Output is rows x gammas by definition; each input row is expanded in place
    (``posexplode`` of the parameter list), so nothing is joined or shuffled.
    """
    gs = _check_gammas(gammas)
    arr = F.array(*[F.lit(g) for g in gs])
    x = with_judge_checked(results, gs, policy).select(*keep, "agree", "min_confidence", "reason", F.col("a.prediction").alias("__pc"),
                       F.col("judge.prediction").alias("__pe"), F.col(truth_col).alias("__truth"),
                       F.posexplode(arr).alias("pos", "gamma"))
    failed = F.col("reason") == "error"
    if policy == "p3":
        esc = ~F.col("agree") | failed
    else:
        esc = ~F.col("agree") | failed | (F.col("min_confidence") < F.col("gamma"))
    final = F.when(failed, F.lit(0)).when(esc, F.col("__pe")).otherwise(F.col("__pc"))
    given = F.col("__truth").isNotNull() & (F.col("__truth") != "")
    return x.select(*keep, "pos", "gamma", esc.alias("escalated"), final.alias("final_prediction"),
                    F.when(given, final == M.truth_binary(F.col("__truth"))).alias("correct"))


# ----------------------------------------------------------------- selection over a sweep
def _ord_max(metric: Column) -> Column:
    return F.when(metric.isNotNull(), F.struct(metric.alias("m"), (-F.col("pos")).alias("p")))


def _ord_min(metric: Column) -> Column:
    return F.when(metric.isNotNull(), F.struct(metric.alias("m"), F.col("pos").alias("p")))


def best_row(sweep: DataFrame, metric: Column, mode: str = "max", by=None, name: str = "best") -> DataFrame:
    """The sweep row with the highest/lowest ``metric``; the first given gamma wins ties."""
    keys = _keys(by)
    row = F.struct(*[F.col(c) for c in sweep.columns if c not in keys])
    ordc = _ord_max(metric) if mode == "max" else _ord_min(metric)
    agg = F.max_by(row, ordc) if mode == "max" else F.min_by(row, ordc)
    return sweep.groupBy(*keys).agg(agg.alias(name)).select(*keys, f"{name}.*")


def best_accuracy(sweep: DataFrame, by=None, accuracy_col: str = "overall_accuracy") -> DataFrame:
    return best_row(sweep, F.col(accuracy_col), "max", by)


def best_efficiency(sweep: DataFrame, by=None, accuracy_col: str = "overall_accuracy") -> DataFrame:
    eff = F.col(accuracy_col) / F.col("avg_calls_per_evaluation")
    return best_row(sweep, eff, "max", by).withColumn("efficiency", eff)


def lowest_cost(sweep: DataFrame, by=None) -> DataFrame:
    return best_row(sweep, F.col("avg_calls_per_evaluation"), "min", by)


def lowest_fcr(sweep: DataFrame, by=None) -> DataFrame:
    return best_row(sweep, F.col("false_consensus_rate"), "min", by)


def best_cost_ratio(sweep: DataFrame, by=None, accuracy_col: str = "overall_accuracy") -> DataFrame:
    """Lowest calls / accuracy (the README's recipe); undefined when accuracy is 0."""
    ratio = F.when(F.col(accuracy_col) > 0, F.col("avg_calls_per_evaluation") / F.col(accuracy_col))
    return best_row(sweep, ratio, "min", by).withColumn("cost_ratio", ratio)


def sweep_ranges(sweep: DataFrame, cols: Sequence[str] = ("gamma", "overall_accuracy", "escalation_rate",
                                                          "avg_calls_per_evaluation", "false_consensus_rate"),
                 by=None) -> DataFrame:
    """min / max of each column."""
    keys = _keys(by)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return sweep.groupBy(*keys).agg(F.count(F.lit(1)).alias("configs"), *aggs)


def sweep_high_escalation(sweep: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Configurations with escalation rate above ``threshold``."""
    return sweep.filter(F.col("escalation_rate") > threshold)


def sweep_top_accuracy(sweep: DataFrame, q: float = 0.8, by=None, accuracy_col: str = "overall_accuracy") -> DataFrame:
    """B15 + F20: rows whose accuracy is strictly above its ``q`` quantile (linear interpolation)."""
    keys = _keys(by)
    part = [F.col(k) for k in keys] if keys else [F.lit(0)]
    w = Window.partitionBy(*part)
    return (sweep.withColumn("accuracy_quantile", F.percentile(F.col(accuracy_col), F.lit(q)).over(w))
            .filter(F.col(accuracy_col) > F.col("accuracy_quantile")))


def diminishing_returns(sweep: DataFrame, by=None, accuracy_col: str = "overall_accuracy",
                        min_gain: float = 0.01) -> DataFrame:
    """Accuracy gain over the previous gamma; flagged when the last gain < ``min_gain``
    and there are more than 3 configurations; names the second-largest gamma."""
    keys = _keys(by)
    part = [F.col(k) for k in keys] if keys else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("gamma", "pos")
    g = sweep.withColumn("gain", F.col(accuracy_col) - F.lag(accuracy_col).over(w)) \
             .withColumn("prev_gamma", F.lag("gamma").over(w))
    last = F.max_by(F.struct("gain", "prev_gamma"), F.struct("gamma", "pos"))
    s = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("configs"), last.alias("l"))
    flagged = (F.col("configs") > 3) & (F.col("l.gain") < min_gain)
    return s.select(*keys, "configs", F.col("l.gain").alias("last_gain"), F.coalesce(flagged, F.lit(False)).alias("flagged"),
                    F.when(flagged, F.col("l.prev_gamma")).alias("beyond_gamma"))


def gamma_sensitivity(results: DataFrame, gammas: Sequence[float] = DEFAULT_GAMMAS, by=None,
                      truth_col: str = "ground_truth") -> DataFrame:
    """How escalation of the *agreeing* rows grows with gamma."""
    keys = _keys(by)
    s = sweep_sums(results, gammas, by, truth_col, mask="agree")
    return s.select(*keys, "pos", "gamma", F.col("n").alias("agreements"), F.col("n_esc").alias("escalated"),
                    (F.col("n_esc") / F.col("n")).alias("escalation_rate"))
