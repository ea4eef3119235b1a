"""The escalation cascade.

``cascade()`` is one narrow plan: verifier A and B answers -> parse ->
gate -> judge answers for gated rows only -> final decision. No shuffle
happens here (a TableVerifier adds its join); metrics aggregate afterwards.

Policies (the three generations of the reference):

* ``p1``: lexical parser + confidence chain; escalate on disagreement or
  ``least(conf_a, conf_b) < gamma``;
* ``p2``: strict parser (0.8 / 0.5); same gate, gamma may be a column;
* ``p3``: strict parser with coin flip; escalate on disagreement only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from verdictflow.functions import parsing as P
from verdictflow.operators.config import CascadeConfig
from verdictflow.operators.verifiers import Verifier, raw_answer

POLICIES = ("p1", "p2", "p3")
RESULT_COLUMNS = ("a", "b", "judge", "agree", "min_confidence", "mean_confidence", "gamma", "escalated", "reason",
                  "final_prediction", "final_verdict", "correct", "calls", "elapsed_ms")
#: What the gate and the decision add to a claim.
GATE_COLUMNS = ("__a_raw", "__b_raw", "a", "b", "gamma", "agree", "min_confidence", "mean_confidence", "escalated", "reason")
DECISION_COLUMNS = ("judge", "final_prediction", "final_verdict", "correct", "calls", "elapsed_ms")


def blank_claim(claim_col: str = "claim") -> Column:
    """NULL, empty or whitespace-only claim (``not claim.strip()``).

    Searching for one non-whitespace character stops at the first one, instead
    of rewriting a whole (possibly 20,000-word) text just to measure it.
    """
    c = P.ident(claim_col)
    return F.expr(f"{c} IS NULL OR NOT ({c} RLIKE {P.lit(r'(?U)\S')})")


def split_blank_claims(claims: DataFrame, claim_col: str = "claim") -> tuple[DataFrame, DataFrame]:
    """B7 quarantine mode: (usable claims, rejected claims) - two filters, no extra pass."""
    bad = blank_claim(claim_col)
    return claims.filter(~bad), claims.filter(bad).withColumn("reject_reason", F.lit("Claim cannot be empty"))


def escalation_gate(agree: Column, min_conf: Column, gamma: Column, policy: str = "p1") -> Column:
    """D6/D7 (disagree or low-confidence agreement) and D8 (disagreement only)."""
    if policy == "p3":
        return ~agree
    return ~agree | (min_conf < gamma)


def escalation_reason(agree: Column, min_conf: Column, gamma: Column, policy: str = "p1") -> Column:
    """Why a row was (not) escalated."""
    low = F.lit(False) if policy == "p3" else (min_conf < gamma)
    return (F.when(~agree, F.lit("disagreement"))
            .when(low, F.lit("low_confidence_agreement"))
            .otherwise(F.lit("consensus")))


def correctness(final_prediction: Column, final_verdict: Column, truth: Column, policy: str = "p1") -> Column:
    """final == truth, only when a truth is given (empty string counts as not given)."""
    given = truth.isNotNull() & (truth != "")
    if policy == "p3":
        return F.when(given, final_verdict == truth)
    gt = F.when(truth == "yes", F.lit(1)).otherwise(F.lit(0))
    return F.when(given, final_prediction == gt)


def cascade(claims: DataFrame, verifier_a: Verifier, verifier_b: Verifier, judge: Verifier,
            gamma: float | Column = 0.7, policy: str = "p1", *, id_col: str = "claim_id", claim_col: str = "claim",
            truth_col: str | None = "ground_truth", seed: int = 0, blank: str = "fail",
            row_error_col: str | None = None, parsers: tuple[str, str, str] | None = None,
            biases: tuple[str | None, str | None] = (None, None), judge_gate: Column | None = None,
            observation: Observation | None = None, judge_partitions: int | None = None,
            materialize: bool = False, config: CascadeConfig | None = None) -> DataFrame:
    """Label every claim with the cascade.

    ``claims`` needs ``id_col`` and ``claim_col``; ``truth_col`` (yes/no) is optional.
    Other columns pass through. ``gamma`` may be a number or a Column (D7).
    ``blank='fail'`` aborts on a blank claim like the reference, ``'quarantine'``
    drops it here (use :func:`split_blank_claims` to keep the rejects), ``'keep'``
    answers it with 'no' ("Empty claim") without asking a model.
    ``row_error_col`` names a column whose non-NULL value fails the row as a
    whole (D13 fallback: prediction 0, confidence 0.1, escalated).
    ``judge_gate`` overrides which rows the judge is asked about.
    ``judge_partitions`` hash-repartitions by the key before the judge, for a slow
    model judge whose escalated rows cluster in a few input partitions.
    ``materialize`` writes the results to the shared checkpoint folder and returns
    the written table: model answers are then computed exactly once, a lost
    executor re-reads them, and every later use (rows, metrics, sweeps) sees the
    same answers. ``config`` (D2) gives the gamma and the policy. ``elapsed_ms`` of a result is the time of
    its calls, NULL where no verifier measures any.
    """
    if config is not None:
        gamma, policy = config.gamma, config.policy
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if not isinstance(gamma, Column) and not (0.0 <= float(gamma) <= 1.0):
        raise ValueError("gamma must be between 0 and 1")
    pa, pb, pj = parsers or (policy, policy, policy)
    claim = F.col(claim_col)
    df = claims
    if blank == "fail":
        # a filter, so that no choice of columns can prune the check away
        df = df.filter(F.when(blank_claim(claim_col), F.raise_error(F.lit("Claim cannot be empty")).cast("boolean"))
                       .otherwise(True))
    elif blank == "quarantine":
        df = df.filter(~blank_claim(claim_col))
    elif blank != "keep":
        raise ValueError("blank must be 'fail', 'quarantine' or 'keep'")

    # a kept blank claim is not sent to a model: every verifier answers it with 'no'
    full = ~blank_claim(claim_col) if blank == "keep" else None

    def answered(d: DataFrame, verifier: Verifier, name: str, gate: Column | None = None) -> DataFrame:
        if full is None:
            return verifier.answers(d, name, claim, gate=gate) if gate is not None else verifier.answers(d, name, claim)
        d = verifier.answers(d, name, claim, gate=full if gate is None else gate & full)
        empty = raw_answer("no", reasoning="Empty claim")
        return d.withColumn(name, F.when(full, F.col(name)).when(F.lit(True) if gate is None else gate, empty))

    df = answered(df, verifier_a, "__a_raw")
    df = answered(df, verifier_b, "__b_raw")
    df = P.parse_roles(df, [("__a_raw", "a", pa, biases[0]), ("__b_raw", "b", pb, biases[1])], id_col, seed)
    failed = f"({P.ident(row_error_col)} IS NOT NULL)" if row_error_col else "FALSE"
    if row_error_col:
        fb = P.fallback_result_sql(f"CAST({P.ident(row_error_col)} AS STRING)")
        df = df.withColumns({"a": F.expr(f"CASE WHEN {failed} THEN {fb} ELSE a END"),
                             "b": F.expr(f"CASE WHEN {failed} THEN {fb} ELSE b END")})

    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    # the gate: cheap expressions over the result structs, inlined into one projection
    agree = "(a.prediction = b.prediction)"
    low = "FALSE" if policy == "p3" else f"(least(a.confidence, b.confidence) < {P.ident('__gamma')})"
    df = df.withColumn("__gamma", g.cast("double")).withColumns({
        "gamma": F.col("__gamma"),
        "agree": F.expr(agree),
        "min_confidence": F.expr("least(a.confidence, b.confidence)"),
        "mean_confidence": F.expr("(a.confidence + b.confidence) / 2"),
        "escalated": F.expr(f"{failed} OR NOT {agree} OR {low}"),
        "reason": F.expr(f"CASE WHEN {failed} THEN 'error' WHEN NOT {agree} THEN 'disagreement' "
                         f"WHEN {low} THEN 'low_confidence_agreement' ELSE 'consensus' END"),
    }).drop("__gamma")
    passed = [c for c in claims.columns if c not in GATE_COLUMNS + DECISION_COLUMNS]
    df = generated(df, passed)

    if judge_partitions:
        df = df.repartition(judge_partitions, F.col(id_col))
    ask = F.col("escalated") if judge_gate is None else judge_gate
    df = answered(df, judge, "__j_raw", ask & ~F.expr(failed))
    df = P.parse_role(df, "__j_raw", "judge", pj, id_col, seed)
    jfb = P.fallback_result_sql(f"CAST({P.ident(row_error_col)} AS STRING)") if row_error_col else "NULL"
    truth = P.ident(truth_col) if truth_col and truth_col in claims.columns else "CAST(NULL AS STRING)"
    given = f"({truth} IS NOT NULL AND {truth} <> '')"
    final = f"(CASE WHEN {failed} THEN 0 WHEN escalated THEN judge.prediction ELSE a.prediction END)"
    verdict = f"(CASE WHEN {final} = 1 THEN 'yes' ELSE 'no' END)"
    hit = f"{verdict} = {truth}" if policy == "p3" else f"{final} = CASE WHEN {truth} = 'yes' THEN 1 ELSE 0 END"
    # the decision columns: cheap expressions over the row, one projection
    df = df.withColumns({
        "judge": F.expr(f"CASE WHEN {failed} THEN {jfb} WHEN escalated THEN judge END"),
        "final_prediction": F.expr(final),
        "final_verdict": F.expr(verdict),
        "correct": F.expr(f"CASE WHEN {given} THEN {hit} END"),
        "calls": F.expr("CASE WHEN escalated THEN 3 ELSE 2 END"),
        "elapsed_ms": F.expr("aggregate(array_compact(array(__a_raw.elapsed_ms, __b_raw.elapsed_ms, __j_raw.elapsed_ms)), "
                             "CAST(NULL AS DOUBLE), (t, x) -> coalesce(t, 0D) + x)"),
    })
    if observation is not None:
        df = observe_calls(df, observation)
    out = df.drop("__a_raw", "__b_raw", "__j_raw")
    if not judge.calls_model:
        out = generated(out, [c for c in out.columns if c not in DECISION_COLUMNS])
    if materialize:
        from verdictflow.session import materialize as _write
        out = _write(out, "cascade")
    return out


def generated(df: DataFrame, passed: list[str]) -> DataFrame:
    """The columns that are not ``passed`` as a relation of their own, generated per row (one row each).

    Catalyst pushes a filter on the ``passed`` columns below the generated relation, down to the scan,
    before any model is asked. A filter on the others stays above it: pushed into the parser
    projections, its condition would grow with every column that a projection uses twice (a filter
    on ``escalated`` then took minutes to plan). The cascade generates the gate's columns, and above
    them the decision's, unless the judge is a model: its projections must be pruned where nothing of
    the judge is selected, so that it is not asked (being nondeterministic, they stop filters by themselves).
    """
    made = [c for c in df.columns if c not in passed]
    return df.select(*map(F.col, passed), F.inline(F.array(F.struct(*map(F.col, made)))))


def observe_calls(results: DataFrame, observation: Observation | str) -> DataFrame:
    """Observed metrics of a cascade: rows, escalations and the judge inputs actually sent.

    ``judge_calls`` counts non-NULL gated judge inputs, i.e. the rows the judge
    was asked about (it equals ``escalations`` unless a ``judge_gate`` widens it).
    Pass a ``pyspark.sql.Observation`` to read them after an action. Observing needs the judge's
    answers and stops filters, so that a cascade is observed only on request.
    """
    return results.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("escalated")).alias("escalations"),
                           F.count(F.col("__j_raw")).alias("judge_calls"),
                           F.sum(F.col("calls")).alias("model_calls"))


def flat_results(results: DataFrame, claim_col: str = "claim") -> DataFrame:
    """The P3 result view with string verdicts."""
    return results.select(
        F.col(claim_col).alias("claim"),
        F.col("a.verdict").alias("verifier_a_verdict"),
        F.col("b.verdict").alias("verifier_b_verdict"),
        F.col("judge.verdict").alias("judge_verdict"),
        "final_verdict", "escalated", F.col("gamma").alias("gamma_threshold"))


def verdict_to_prediction(verdict: Column) -> Column:
    """B8: 'yes' -> 1, anything else -> 0."""
    return F.when(verdict == "yes", F.lit(1)).otherwise(F.lit(0))


def prediction_to_verdict(prediction: Column) -> Column:
    """1 -> 'yes', anything else -> 'no'."""
    return F.when(prediction == 1, F.lit("yes")).otherwise(F.lit("no"))


def preview(text: Column, n: int = 150) -> Column:
    """First ``n`` characters + '...' when longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def forced_disagreement(claims: DataFrame, verifier: Verifier, judge: Verifier, *, seed: int = 0,
                        id_col: str = "claim_id", claim_col: str = "claim", truth_col: str | None = "ground_truth",
                        prefixes: tuple[str, str] = ("Lean towards accepting this: ", "Lean towards rejecting this: ")
                        ) -> DataFrame:
    """A yes-biased and a no-biased copy of one verifier (``prefixes`` before the claim); the judge
    decides every disagreement."""
    a, b = map(verifier.with_prefix, prefixes)
    return cascade(claims, a, b, judge, 0.0, "p3", id_col=id_col, claim_col=claim_col, truth_col=truth_col,
                   seed=seed, parsers=("biased", "biased", "p3"), biases=("yes", "no"))


def evaluate_dataset(dataset: DataFrame, verifier_a: Verifier, verifier_b: Verifier, judge: Verifier,
                     gamma: float = 0.7, label_col: str = "label", require_balanced: bool = False,
                     **kw) -> DataFrame:
    """D12 batch: validate the labels (B1-B4, strict and case-sensitive like the reference),
    normalise them (B5) into ``ground_truth``, then run the cascade."""
    from verdictflow.operators.validation import normalize_labels, validate_dataset
    validate_dataset(dataset, label_col, require_balanced)
    claims = normalize_labels(dataset, label_col, "ground_truth")
    return cascade(claims, verifier_a, verifier_b, judge, gamma, **kw)


def evaluate_claim(spark, claim: str, verifier_a: Verifier, verifier_b: Verifier, judge: Verifier,
                   gamma: float = 0.7, ground_truth: str | None = None, **kw):
    """D12 single claim: a one-row DataFrame through the same cascade; returns the result row."""
    if not claim or not claim.strip():
        raise ValueError("Claim cannot be empty")
    df = spark.createDataFrame([(0, claim, ground_truth)], "claim_id long, claim string, ground_truth string")
    return cascade(df, verifier_a, verifier_b, judge, gamma, **kw).first()


def attach_truth(results: DataFrame, truth: DataFrame, key: str = "claim_id", truth_col: str = "ground_truth",
                 policy: str = "p1") -> DataFrame:
    """E1 at scale: join the ground truth *after* the cascade and recompute ``correct``.

    With large claim texts, joining labels before the cascade shuffles every text
    (a sort-merge join on the key); joining after it shuffles only the narrow
    result columns. Rows without a truth keep ``correct`` NULL (left join).
    """
    r = results.drop(truth_col) if truth_col in results.columns else results
    j = r.join(truth.select(key, truth_col), key, "left")
    t = P.ident(truth_col)
    hit = f"final_verdict = {t}" if policy == "p3" else f"final_prediction = CASE WHEN {t} = 'yes' THEN 1 ELSE 0 END"
    return j.withColumn("correct", F.expr(f"CASE WHEN {t} IS NOT NULL AND {t} <> '' THEN {hit} END"))
