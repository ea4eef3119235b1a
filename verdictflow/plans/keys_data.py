"""Keys for validation and labels (B1-B15), joins (E1-E4), comparison (F19, G6), summaries
(F21-F25), sampling and positions (G8-G13) and sources/sinks (A5-A14)."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from verdictflow.operators import metrics as M
from verdictflow.operators import sampling as SM
from verdictflow.operators import validation as V
from verdictflow.operators.cascade import cascade, flat_results, prediction_to_verdict, preview
from verdictflow.operators.config import CascadeConfig
from verdictflow.operators.verifiers import RuleVerifier
from verdictflow.plans import compare as C
from verdictflow.plans import oracle as O
from verdictflow.plans import sweep as S
from verdictflow.plans.keys import FLAT_DOUBLES, GAMMA, GAMMAS, METRIC_DOUBLES, all_results, flat_cols, results
from verdictflow.plans.registry import register, with_ctes
from verdictflow.session import durable_path, materialize
from verdictflow.sources import datasets as D
from verdictflow.sources import sinks as K
from verdictflow.sources.derived import (all_claims, document_claims, fixture_answer, fixture_verifiers, labelled_claims,
                                         table, text_key)

RAW_LABELS = ("yes", "no", "true", "false", "1", "0", "Yes", " no ", "maybe")
RAW_LABEL_SPARK = "element_at(array(" + ", ".join(f"'{v}'" for v in RAW_LABELS) + \
    "), CAST((doc_id * 7 + quality) % 9 + 1 AS INT))"
RAW_LABEL_SQL = "([" + ", ".join(f"'{v}'" for v in RAW_LABELS) + "])[(doc_id * 7 + quality) % 9 + 1]"


def raw_labels(spark, sf_dir):
    """Label strings as a user file might spell them (valid, odd-cased, padded, invalid)."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"),
                                                  F.expr(RAW_LABEL_SPARK).alias("label"))


RAW_LABELS_CTE = f"rl AS (SELECT doc_id AS claim_id, {RAW_LABEL_SQL} AS label FROM labels)"


# ----------------------------------------------------------------- B1 - B7
@register("check_alignment", "SELECT CAST(sum(CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 1 ELSE 0 END) "
                             "AS BIGINT) AS matched, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
                             "AS claims_only, CAST(sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
                             "AS labels_only FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def q_check_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"))
    return V.check_alignment(docs, labels)


def _summary_sql(cols):
    valid = "label IN ('yes', 'no', 'true', 'false', '1', '0')"
    pos = "label IN ('yes', 'true', '1')"
    inner = (f"SELECT count(*) AS size, CAST(sum(CASE WHEN NOT coalesce({valid}, FALSE) THEN 1 ELSE 0 END) AS BIGINT) "
             f"AS invalid, count(DISTINCT CASE WHEN NOT {valid} THEN label END) AS invalid_distinct, CAST(sum(CASE WHEN coalesce({pos}, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS positive "
             f"FROM rl")
    return with_ctes(RAW_LABELS_CTE + f", s AS ({inner})",
                     f"SELECT {cols} FROM (SELECT size, invalid, invalid_distinct, positive, size - positive AS negative, "
                     f"abs(2 * positive - size) <= 1 AS balanced FROM s) x")


@register("validate_dataset", _summary_sql("size, invalid, invalid_distinct, positive, negative, balanced"))
def q_validate_dataset(spark, sf_dir):
    return V.label_summary(raw_labels(spark, sf_dir))


@register("validate_balance", _summary_sql("positive, negative, balanced"))
def q_validate_balance(spark, sf_dir):
    return V.label_summary(raw_labels(spark, sf_dir)).select("positive", "negative", "balanced")


@register("invalid_labels", with_ctes(RAW_LABELS_CTE, "SELECT DISTINCT label FROM rl WHERE label NOT IN "
                                                      "('yes', 'no', 'true', 'false', '1', '0')"))
def q_invalid_labels(spark, sf_dir):
    return V.invalid_labels(raw_labels(spark, sf_dir))


@register("normalize_labels", with_ctes(
    RAW_LABELS_CTE, "SELECT claim_id, label, CASE WHEN lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')) "
                    "IN ('yes', 'true', '1') THEN 'yes' WHEN lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')) "
                    "IN ('no', 'false', '0') THEN 'no' END AS normalized FROM rl"))
def q_normalize_labels(spark, sf_dir):
    return V.normalize_labels(raw_labels(spark, sf_dir), "label", "normalized", mode="lenient")


@register("label_binary", with_ctes(RAW_LABELS_CTE,
                                    "SELECT claim_id, label, CASE WHEN label = 'yes' THEN 1 ELSE 0 END AS binary FROM rl"))
def q_label_binary(spark, sf_dir):
    r = raw_labels(spark, sf_dir)
    return r.select("claim_id", "label", V.label_binary(F.col("label")).alias("binary"))


@register("blank_claims", "SELECT CAST(sum(CASE WHEN text IS NULL OR length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) "
                          "= 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(sum(CASE WHEN text IS NOT NULL AND "
                          "length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 THEN 1 ELSE 0 END) AS BIGINT) "
                          "AS usable, CAST(sum(length(text)) AS BIGINT) AS usable_chars FROM documents")
def q_blank_claims(spark, sf_dir):
    from verdictflow.operators.cascade import blank_claim
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    # B7 over every whole text; both counts in one conditional aggregate
    return docs.agg(F.count_if(blank_claim("claim")).alias("blank"), F.count_if(~blank_claim("claim")).alias("usable"),
                    F.sum(F.length("claim")).alias("usable_chars"))


# ----------------------------------------------------------------- B8 - B15
@register("verdict_projection", with_ctes(
    O.cascade_ctes(), "SELECT claim_id, final_prediction, final_verdict, a_prediction, "
                      "CASE WHEN a_prediction = 1 THEN 'yes' ELSE 'no' END AS a_verdict_back FROM res"))
def q_verdict_projection(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("claim_id", "final_prediction", "final_verdict", F.col("a.prediction").alias("a_prediction"),
                    prediction_to_verdict(F.col("a.prediction")).alias("a_verdict_back"))


@register("flat_results", with_ctes(
    O.cascade_ctes(policy="p3"), "SELECT claim, a_verdict AS verifier_a_verdict, b_verdict AS verifier_b_verdict, "
                                 "judge_verdict, final_verdict, escalated, gamma AS gamma_threshold FROM res"),
    ("gamma_threshold",))
def q_flat_results(spark, sf_dir):
    return flat_results(results(spark, sf_dir, policy="p3"))


EMPTY_TRUTH_SQL = "CASE WHEN claim_id % 13 = 0 THEN '' ELSE ground_truth END"


@register("correct_flag", with_ctes(
    O.cascade_ctes(claims=f"SELECT claim_id, claim, {EMPTY_TRUTH_SQL} AS ground_truth, lang, source, text_key FROM "
                          f"({O.claims_sql()}) c"),
    "SELECT claim_id, ground_truth, final_verdict, correct FROM res"))
def q_correct_flag(spark, sf_dir):
    a, b, j = fixture_verifiers()
    c = document_claims(spark, sf_dir).withColumn("ground_truth", F.expr(EMPTY_TRUTH_SQL))
    return cascade(c, a, b, j, GAMMA).select("claim_id", "ground_truth", "final_verdict", "correct")


@register("row_cost", with_ctes(O.cascade_ctes(), "SELECT lang, count(*) AS claims, CAST(sum(calls) AS BIGINT) AS calls "
                                                  "FROM res GROUP BY lang"))
def q_row_cost(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("claims"),
                                 F.sum(M.row_cost(F.col("escalated"))).cast("bigint").alias("calls"))


def _err_results(spark, sf_dir):
    a, b, j = fixture_verifiers(errors=True)
    return cascade(document_claims(spark, sf_dir), a, b, j, GAMMA)


OK_SQL = "(a_e IS NULL AND b_e IS NULL AND (NOT escalated OR j_e IS NULL))"


@register("successful_only", with_ctes(
    O.cascade_ctes(errors=True), f"SELECT lang, count(*) AS claims, CAST(sum(CASE WHEN {OK_SQL} THEN 1 ELSE 0 END) "
                                 f"AS BIGINT) AS successful FROM res GROUP BY lang"))
def q_successful_only(spark, sf_dir):
    return _err_results(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("claims"),
                                                           F.count_if(M.answered()).alias("successful"))


JSON_FIELDS = ("total_evaluations", "escalations", "overall_accuracy", "escalated_accuracy", "non_escalated_accuracy")


def _metrics_json_sql():
    parts = []
    for f in JSON_FIELDS:
        v = f"round({f}, 6)" if f.endswith("accuracy") else f
        parts.append(f"CASE WHEN {f} IS NOT NULL THEN '\"{f}\":' || CAST({v} AS VARCHAR) END")
    js = "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"
    return with_ctes(O.cascade_ctes() + f",\ns AS ({O.sums_sql('res', 'lang, reason')}),\n"
                     f"m AS (SELECT lang, reason, {O.derive_sql()} FROM s)", f"SELECT lang, reason, {js} AS metrics FROM m")


@register("metrics_json", _metrics_json_sql())
def q_metrics_json(spark, sf_dir):
    m = M.evaluation_metrics(results(spark, sf_dir), by=["lang", "reason"])
    fields = [F.round(F.col(f), 6).alias(f) if f.endswith("accuracy") else F.col(f) for f in JSON_FIELDS]
    return m.select("lang", "reason", F.to_json(F.struct(*fields)).alias("metrics"))


def _metrics_json_full_sql():
    names = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in M.RESULT_FIELDS)
    return with_ctes(O.cascade_ctes(claims=O.claims_sql()) +
                     f",\nm AS ({O.optional_truth_sql('res', 'lang, reason')})",
                     f"SELECT lang, reason, concat_ws(',', {names}) AS fields, {', '.join(M.RESULT_FIELDS)} FROM m")


@register("metrics_json_full", _metrics_json_full_sql(), METRIC_DOUBLES[:-1])
def q_metrics_json_full(spark, sf_dir):
    """The JSON form of all 18 metric fields, unrounded, without the undefined ones; parsed again."""
    m = M.evaluation_metrics(all_results(spark, sf_dir), by=["lang", "reason"])
    fields = m.select(*M.RESULT_FIELDS).schema
    m = m.select("lang", "reason", M.metrics_json().alias("metrics"))
    return m.select("lang", "reason", F.array_join(F.json_object_keys("metrics"), ",").alias("fields"),
                    F.from_json("metrics", fields).alias("m")).select("lang", "reason", "fields", "m.*")


@register("reasoning_preview", "SELECT doc_id AS claim_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' "
                               "ELSE text END AS claim_60, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || "
                               "'...' ELSE text END AS text_150, length(text) AS n_chars FROM documents")
def q_reasoning_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("claim_id"), preview(F.col("text"), 60).alias("claim_60"),
                    preview(F.col("text"), 150).alias("text_150"), F.length("text").cast("bigint").alias("n_chars"))


# ----------------------------------------------------------------- E1, E3, E4, F19, G6
def _unlabelled_claims_sql():
    return ("SELECT doc_id AS claim_id, text AS claim, CAST(NULL AS VARCHAR) AS ground_truth, lang, source, "
            f"{O.text_key_sql('text')} AS text_key FROM documents")


@register("results_with_truth", with_ctes(
    O.cascade_ctes(claims=_unlabelled_claims_sql()),
    "SELECT r.claim_id, r.final_verdict, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS ground_truth, "
    "r.final_prediction = CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS correct FROM res r JOIN labels l "
    "ON r.claim_id = l.doc_id"))
def q_results_with_truth(spark, sf_dir):
    a, b, j = fixture_verifiers()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"),
                                                   text_key("text").alias("text_key"))
    r = cascade(docs, a, b, j, GAMMA, truth_col=None)
    truth = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("claim_id"),
        F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no")).alias("ground_truth"))
    from verdictflow.operators.cascade import attach_truth
    return attach_truth(r, truth).filter(F.col("ground_truth").isNotNull()).select(
        "claim_id", "final_verdict", "ground_truth", "correct")


@register("sweep_cross", with_ctes(
    O.sweep_ctes(GAMMAS), "SELECT claim_id, pos, gamma_in AS gamma, escalated, final_prediction, correct FROM res"),
    ("gamma",))
def q_sweep_cross(spark, sf_dir):
    return S.gamma_decisions(results(spark, sf_dir, max(GAMMAS)), GAMMAS)


def _paired_sql(select):
    ra = O.cascade_ctes("ra_", gamma=0.5)
    rb = O.cascade_ctes("rb_", gamma=0.9)
    p = ("SELECT a.claim_id, a.ground_truth, a.final_prediction AS final_a, b.final_prediction AS final_b, "
         "CAST(a.final_prediction = CASE WHEN a.ground_truth = 'yes' THEN 1 ELSE 0 END AS INTEGER) AS hit_a, "
         "CAST(b.final_prediction = CASE WHEN b.ground_truth = 'yes' THEN 1 ELSE 0 END AS INTEGER) AS hit_b "
         "FROM ra_res a JOIN rb_res b ON a.claim_id = b.claim_id WHERE a.ground_truth IS NOT NULL")
    return with_ctes(f"{ra},\n{rb},\np AS (SELECT *, hit_a - hit_b AS diff FROM ({p}) x)", select)


def _paired(spark, sf_dir):
    return results(spark, sf_dir, 0.5), results(spark, sf_dir, 0.9)


@register("paired_runs", _paired_sql("SELECT claim_id, ground_truth, final_a, final_b, hit_a, hit_b, diff FROM p"))
def q_paired_runs(spark, sf_dir):
    return C.paired_runs(*_paired(spark, sf_dir))


PAIRED_TTEST = (
    "SELECT count(*) AS n, avg(hit_a) AS mean_accuracy_a, avg(hit_b) AS mean_accuracy_b, "
    "avg(hit_a) - avg(hit_b) AS accuracy_difference, CASE WHEN stddev_samp(diff) > 0 THEN avg(diff) / "
    "(stddev_samp(diff) / sqrt(count(*))) END AS t_statistic, CASE WHEN stddev_pop(diff) > 0 THEN avg(diff) / "
    "stddev_pop(diff) ELSE 0.0 END AS cohens_d FROM p")


@register("paired_ttest", _paired_sql(PAIRED_TTEST),
          ("mean_accuracy_a", "mean_accuracy_b", "accuracy_difference", "t_statistic", "cohens_d"))
def q_paired_ttest(spark, sf_dir):
    return C.paired_ttest(*_paired(spark, sf_dir), with_p=False)


def _ttest_p_sql():
    """The tail by the finite series in cos(atan(t / sqrt(df))), one form for even and one for odd df."""
    cols = "n, mean_accuracy_a, mean_accuracy_b, accuracy_difference, t_statistic, cohens_d"
    even = ("sin(w) * coalesce(list_sum(list_transform(range(CAST(df // 2 AS BIGINT)), lambda i: "
            "exp(lgamma(i + 0.5) - lgamma(i + 1)) / sqrt(pi()) * pow(cos(w), 2 * i))), 0)")
    odd = ("2 / pi() * (w + sin(w) * coalesce(list_sum(list_transform(range(CAST((df - 1) // 2 AS BIGINT)), lambda i: "
           "exp(lgamma(i + 1) - lgamma(i + 1.5)) * sqrt(pi()) / 2 * pow(cos(w), 2 * i + 1))), 0))")
    return _paired_sql(
        f"SELECT {cols}, p_value, coalesce(p_value < 0.05, FALSE) AS significant FROM (SELECT *, CASE WHEN t_statistic IS "
        f"NOT NULL AND df > 0 THEN 1 - CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END END AS p_value FROM (SELECT *, n - 1 AS "
        f"df, atan(abs(t_statistic) / sqrt(n - 1)) AS w FROM ({PAIRED_TTEST}) x) y)")


@register("paired_ttest_p", _ttest_p_sql(),
          ("mean_accuracy_a", "mean_accuracy_b", "accuracy_difference", "t_statistic", "cohens_d", "p_value"))
def q_paired_ttest_p(spark, sf_dir):
    """F19 with the Student-t p-value."""
    return C.paired_ttest(*_paired(spark, sf_dir))


def _configs_sql():
    ctes = [O.cascade_ctes(f"c{i}_", policy=p) for i, p in enumerate(("p1", "p2", "p3"))]
    u = " UNION ALL ".join(f"SELECT '{p}' AS config, {i} AS pos, * FROM ({O.sums_sql(f'c{i}_res')}) s{i}"
                           for i, p in enumerate(("p1", "p2", "p3")))
    m = (f"m AS (SELECT config, pos, {O._div('n_hit', 'n_lab')} AS overall_accuracy, {O._div('n_calls', 'n')} AS "
         f"avg_calls_per_evaluation, {O._div('n_hit', 'n_lab')} / {O._div('n_calls', 'n')} AS efficiency, "
         f"{O._div('n_esc', 'n')} AS escalation_rate FROM ({u}) u)")
    sel = ("SELECT config, pos, overall_accuracy, avg_calls_per_evaluation, efficiency, escalation_rate, "
           "config = (SELECT config FROM m ORDER BY overall_accuracy DESC, pos LIMIT 1) AS best_accuracy, "
           "config = (SELECT config FROM m ORDER BY efficiency DESC, pos LIMIT 1) AS best_efficiency, "
           "config = (SELECT config FROM m ORDER BY avg_calls_per_evaluation ASC, pos LIMIT 1) AS lowest_cost FROM m")
    return with_ctes(",\n".join(ctes) + ",\n" + m, sel)


@register("compare_configs", _configs_sql(),
          ("overall_accuracy", "avg_calls_per_evaluation", "efficiency", "escalation_rate"))
def q_compare_configs(spark, sf_dir):
    parts = [results(spark, sf_dir, policy=p).select("claim_id", "ground_truth", "final_prediction", "escalated",
                                                     "agree", F.lit(p).alias("config"), F.lit(i).alias("pos"))
             for i, p in enumerate(("p1", "p2", "p3"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return C.compare_configs(u, "config", "pos")


# ----------------------------------------------------------------- F21 - F25
@register("timing_confidence", with_ctes(
    O.cascade_ctes(errors=True), f"SELECT lang, count(*) AS successful, avg(a_confidence) AS avg_a_confidence, "
                                 f"avg(b_confidence) AS avg_b_confidence, (avg(a_confidence) + avg(b_confidence)) / 2 "
                                 f"AS avg_confidence FROM res WHERE {OK_SQL} GROUP BY lang"),
    ("avg_a_confidence", "avg_b_confidence", "avg_confidence"))
def q_timing_confidence(spark, sf_dir):
    return M.timing_confidence(_err_results(spark, sf_dir), by="lang")


@register("disagreement_analysis", with_ctes(
    O.cascade_ctes(errors=True), f"SELECT lang, CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreements, "
                                 f"CAST(sum(CASE WHEN NOT agree THEN 1 ELSE 0 END) AS BIGINT) AS disagreements, "
                                 f"count(*) AS successful, sum(CASE WHEN NOT agree THEN 1 ELSE 0 END) / count(*) "
                                 f"AS disagreement_rate FROM res WHERE {OK_SQL} GROUP BY lang"), ("disagreement_rate",))
def q_disagreement_analysis(spark, sf_dir):
    return M.disagreement_analysis(_err_results(spark, sf_dir), by="lang")


@register("macro_escalation", with_ctes(
    O.cascade_ctes(), "SELECT avg(r) AS macro_escalation_rate, count(*) AS categories FROM (SELECT lang, "
                      "avg(CASE WHEN escalated THEN 1.0 ELSE 0.0 END) AS r FROM res GROUP BY lang) x"),
    ("macro_escalation_rate",))
def q_macro_escalation(spark, sf_dir):
    return M.macro_escalation(results(spark, sf_dir), "lang")


QUICK_N = 10


def _quick_claims_sql():
    return (f"SELECT * FROM ({O.claims_sql()}) c ORDER BY md5('0:sample:' || CAST(claim_id AS VARCHAR)), claim_id "
            f"LIMIT {QUICK_N}")


@register("quick_eval", with_ctes(
    O.cascade_ctes(claims=_quick_claims_sql()),
    "SELECT count(*) AS num_claims, CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS num_escalations, "
    "avg(CASE WHEN escalated THEN 1.0 ELSE 0.0 END) AS escalation_rate, avg(CASE WHEN coalesce(correct, FALSE) THEN 1.0 "
    "ELSE 0.0 END) AS accuracy, avg(calls) AS avg_cost FROM res"), ("escalation_rate", "accuracy", "avg_cost"))
def q_quick_eval(spark, sf_dir):
    a, b, j = fixture_verifiers()
    c = SM.sample_n(document_claims(spark, sf_dir), QUICK_N, 0)
    r = M.cascade_metrics(cascade(c, a, b, j, GAMMA))
    return r.select(F.col("total_evaluations").alias("num_claims"), F.col("escalations").alias("num_escalations"),
                    "escalation_rate", F.col("overall_accuracy").alias("accuracy"),
                    F.col("avg_calls_per_evaluation").alias("avg_cost"))


@register("quick_eval_rows", with_ctes(
    O.cascade_ctes(claims=f"SELECT * FROM ({O.claims_sql()}) c ORDER BY md5('0:sample:' || CAST(claim_id AS VARCHAR)), "
                          f"claim_id LIMIT {QUICK_N}"),
    "SELECT 'summary' AS type, count(*) AS num_claims, count(*) FILTER (escalated) AS num_escalations, "
    "avg(CAST(escalated AS INTEGER)) AS escalation_rate, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, "
    f"avg(calls) AS avg_cost FROM res UNION ALL BY NAME SELECT 'result' AS type, claim, {O.FLAT_COLS} FROM res"),
    ("escalation_rate", "accuracy", "avg_cost") + FLAT_DOUBLES)
def q_quick_eval_rows(spark, sf_dir):
    """F24 with its result rows; the sample is answered once."""
    c = SM.sample_n(all_claims(spark, sf_dir), QUICK_N, 0)
    r = cascade(c, *fixture_verifiers(), GAMMA, materialize=True)
    summary = M.cascade_metrics(r).select(
        F.col("total_evaluations").alias("num_claims"), F.col("escalations").alias("num_escalations"), "escalation_rate",
        F.col("overall_accuracy").alias("accuracy"), F.col("avg_calls_per_evaluation").alias("avg_cost"))
    return K.typed_records(None, ("summary", summary), ("result", r.select("claim", *flat_cols())))


def _typed_claims_sql():
    return (f"SELECT *, CASE WHEN ground_truth IS NULL THEN 'contested_factual' ELSE 'labeled' END AS type "
            f"FROM ({O.claims_sql()}) every")


def typed_claims(spark, sf_dir):
    kind = F.when(F.col("ground_truth").isNull(), F.lit("contested_factual")).otherwise(F.lit("labeled"))
    return document_claims(spark, sf_dir).withColumn("type", kind)


@register("by_type_summary", with_ctes(
    O.cascade_ctes(claims=_typed_claims_sql()),
    "SELECT type, count(*) AS claims, CAST(sum(CASE WHEN ground_truth IS NOT NULL AND ground_truth <> '' THEN 1 ELSE 0 END) "
    "AS BIGINT) AS labelled, avg(CASE WHEN ground_truth IS NOT NULL AND ground_truth <> '' THEN CAST(correct AS INTEGER) "
    "END) AS accuracy, avg(CAST(escalated AS INTEGER)) AS escalation_rate, avg(CAST(NOT agree AS INTEGER)) "
    "AS disagreement_rate FROM res GROUP BY type"), ("accuracy", "escalation_rate", "disagreement_rate"))
def q_by_type_summary(spark, sf_dir):
    a, b, j = fixture_verifiers()
    return M.by_type_summary(cascade(typed_claims(spark, sf_dir), a, b, j, GAMMA))


# ----------------------------------------------------------------- G8 - G13
@register("running_rates", with_ctes(
    O.cascade_ctes(), "SELECT i, claim_id, escalation_rate, accuracy FROM (SELECT row_number() OVER w - 1 AS i, claim_id, "
                      "sum(CAST(escalated AS INTEGER)) OVER w / row_number() OVER w AS escalation_rate, "
                      "sum(CAST(coalesce(correct, FALSE) AS INTEGER)) OVER w / row_number() OVER w AS accuracy "
                      "FROM res WINDOW w AS (ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x "
                      "WHERE i > 0 AND i % 10 = 0"), ("escalation_rate", "accuracy"))
def q_running_rates(spark, sf_dir):
    return SM.running_rates(results(spark, sf_dir), ["claim_id"], 10)


SAMPLE_N = 100


@register("sample_n", with_ctes(f"c AS ({O.claims_sql(False)})",
                                f"SELECT claim_id, ground_truth FROM c ORDER BY md5('0:sample:' || CAST(claim_id AS VARCHAR)), "
                                f"claim_id LIMIT {SAMPLE_N}"))
def q_sample_n(spark, sf_dir):
    return SM.sample_n(document_claims(spark, sf_dir, with_text=False), SAMPLE_N, 0).select("claim_id", "ground_truth")


BALANCED_SIZE = 201


def _balanced_sql(size=BALANCED_SIZE):
    half = (size + size % 2) // 2
    c = f"c AS ({O.claims_sql(False)})"
    n = "n AS (SELECT ground_truth, count(*) AS pool FROM c GROUP BY ground_truth)"
    r = (f"r AS (SELECT c.claim_id, c.ground_truth, n.pool, CAST(ceil({half} / n.pool) AS BIGINT) AS rounds FROM c "
         f"JOIN n ON c.ground_truth = n.ground_truth)")
    full = "SELECT claim_id, ground_truth, unnest(range(0, rounds - 1)) AS round FROM r WHERE rounds > 1"
    last = (f"SELECT claim_id, ground_truth, rounds - 1 AS round FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"ground_truth ORDER BY md5('0:balanced:' || ground_truth || ':' || CAST(rounds - 1 AS VARCHAR) || ':' || "
            f"CAST(claim_id AS VARCHAR)), claim_id) AS rn FROM r) x WHERE rn <= {half} - (rounds - 1) * pool")
    return with_ctes(f"{c}, {n}, {r}", f"SELECT claim_id, ground_truth, CAST(round AS INTEGER) AS round FROM "
                                       f"({full} UNION ALL {last}) u")


@register("balanced_sample", _balanced_sql())
def q_balanced_sample(spark, sf_dir):
    s = SM.balanced_sample(document_claims(spark, sf_dir, with_text=False), BALANCED_SIZE, 0)
    return s.select("claim_id", "ground_truth", F.col("round").cast("int").alias("round"))


def _synthetic_sql():
    c = f"c AS ({O.claims_sql(False)})"
    n = "n AS (SELECT ground_truth, count(*) AS pool FROM c GROUP BY ground_truth)"
    idx = ("p AS (SELECT claim_id, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY claim_id) - 1 "
           "AS idx FROM c)")
    slots = ("s AS (SELECT i, CASE WHEN i % 2 = 0 THEN 'yes' ELSE 'no' END AS ground_truth, "
             "('0x' || substr(md5('0:synthetic:' || CAST(i AS VARCHAR)), 1, 12))::BIGINT AS h "
             "FROM range(0, (SELECT count(*) FROM c)) t(i))")
    return with_ctes(f"{c}, {n}, {idx}, {slots}",
                     "SELECT s.i, s.ground_truth, p.claim_id FROM s JOIN n ON s.ground_truth = n.ground_truth "
                     "JOIN p ON p.ground_truth = s.ground_truth AND p.idx = s.h % n.pool")


@register("synthetic_alternating", _synthetic_sql())
def q_synthetic_alternating(spark, sf_dir):
    pool = document_claims(spark, sf_dir, with_text=False)
    size = pool.count()  # one number to the driver: the synthetic set is as large as the labelled pool
    return SM.synthetic_alternating(spark, pool, size, 0).select("i", "ground_truth", "claim_id")


@register("shuffled", with_ctes(f"c AS ({O.claims_sql(False)})", "SELECT claim_id, ground_truth FROM c"))
def q_shuffled(spark, sf_dir):
    return SM.shuffled(document_claims(spark, sf_dir, with_text=False), 0).select("claim_id", "ground_truth")


@register("head_n", with_ctes(f"c AS ({O.claims_sql(False)})",
                              "SELECT claim_id, ground_truth FROM c ORDER BY claim_id LIMIT 10"))
def q_head_n(spark, sf_dir):
    return SM.head_n(document_claims(spark, sf_dir, with_text=False), 10).select("claim_id", "ground_truth")


# ----------------------------------------------------------------- A5 - A14
@register("tag_dataset", with_ctes(f"c AS ({O.claims_sql(False)})",
                                   "SELECT claim_id, ground_truth, 'documents' AS dataset FROM c"))
def q_tag_dataset(spark, sf_dir):
    return D.tag_dataset(document_claims(spark, sf_dir, with_text=False), "documents").select(
        "claim_id", "ground_truth", "dataset")


@register("roundtrip_dataset", with_ctes(f"c AS ({O.labelled_claims_sql()})", "SELECT claim, ground_truth AS label FROM c"))
def q_roundtrip_dataset(spark, sf_dir):
    """A9 -> A3: write the labelled claims as CSV (whole texts, quotes, newlines) and read them back."""
    path = durable_path(spark, "roundtrip") + ".csv"
    K.save_dataset(labelled_claims(spark, sf_dir).withColumnRenamed("ground_truth", "label"), path)
    return D.read_claims(spark, path).select("claim", "label")


@register("load_named_dataset", with_ctes(f"c AS ({O.labelled_claims_sql()})", "SELECT claim, ground_truth AS label FROM c"))
def q_load_named_dataset(spark, sf_dir):
    """A5 with a path: JSON Lines written from the labelled claims, loaded back by name (suffix)."""
    path = durable_path(spark, "named") + ".jsonl"
    K.save_dataset(labelled_claims(spark, sf_dir).withColumnRenamed("ground_truth", "label"), path)
    return D.load_named_dataset(spark, path).select("claim", "label")


def _records_sql():
    res = O.cascade_ctes(claims=_typed_claims_sql())
    lab = ("SELECT 'labeled' AS type, claim_id, ground_truth AS expected, final_verdict AS predicted, correct, "
           "escalated, a_confidence, b_confidence, judge_confidence AS ref_confidence FROM res WHERE type = 'labeled'")
    con = ("SELECT 'contested_factual' AS type, claim_id, a_prediction AS verifier_a, b_prediction AS verifier_b, "
           "final_prediction AS final, escalated, a_confidence, b_confidence, judge_confidence AS ref_confidence "
           "FROM res WHERE type = 'contested_factual'")
    summ = ("SELECT 'summary' AS type, avg(CASE WHEN type = 'labeled' THEN CAST(correct AS INTEGER) END) AS "
            "labeled_accuracy, avg(CASE WHEN type = 'contested_factual' THEN CAST(escalated AS INTEGER) END) AS "
            "contested_factual_escalation_rate, CAST(sum(calls) AS BIGINT) AS total_model_calls FROM res")
    meta = f"SELECT 'metadata' AS type, CAST({GAMMA} AS DOUBLE) AS gamma, 0 AS seed"
    return with_ctes(res, f"{meta} UNION ALL BY NAME {lab} UNION ALL BY NAME {con} UNION ALL BY NAME {summ}")


@register("jsonl_records", _records_sql(), ("a_confidence", "b_confidence", "ref_confidence", "labeled_accuracy",
                                            "contested_factual_escalation_rate", "gamma"))
def q_jsonl_records(spark, sf_dir):
    a, b, j = fixture_verifiers()
    # the records of three kinds come from one cascade
    r = materialize(cascade(typed_claims(spark, sf_dir), a, b, j, GAMMA).drop("claim"), "records")
    lab = r.filter(F.col("type") == "labeled").select(
        "claim_id", F.col("ground_truth").alias("expected"), F.col("final_verdict").alias("predicted"), "correct",
        "escalated", F.col("a.confidence").alias("a_confidence"), F.col("b.confidence").alias("b_confidence"),
        F.col("judge.confidence").alias("ref_confidence"))
    con = r.filter(F.col("type") == "contested_factual").select(
        "claim_id", F.col("a.prediction").alias("verifier_a"), F.col("b.prediction").alias("verifier_b"),
        F.col("final_prediction").alias("final"), "escalated", F.col("a.confidence").alias("a_confidence"),
        F.col("b.confidence").alias("b_confidence"), F.col("judge.confidence").alias("ref_confidence"))
    summ = r.agg(F.avg(F.when(F.col("type") == "labeled", F.col("correct").cast("int"))).alias("labeled_accuracy"),
                 F.avg(F.when(F.col("type") == "contested_factual", F.col("escalated").cast("int")))
                 .alias("contested_factual_escalation_rate"),
                 F.sum("calls").cast("bigint").alias("total_model_calls"))
    meta = spark.range(1).select(F.lit(GAMMA).cast("double").alias("gamma"), F.lit(0).alias("seed"))
    return K.typed_records(meta, ("labeled", lab), ("contested_factual", con), ("summary", summ))


RECORD_ERROR_SQL = "CASE claim_id % 29 WHEN 3 THEN 'timeout' WHEN 7 THEN 'upstream failure' END"
RECORD_DOUBLES = ("time", "a_confidence", "b_confidence", "ref_confidence", "gamma", "labeled_accuracy",
                  "contested_factual_escalation_rate", "temperature_a", "temperature_b", "temperature_referee")


def _full_records_sql():
    """Every record with all its fields; each call takes text_key % 1000 ms."""
    short = "CASE WHEN length({0}) > 150 THEN substring({0}, 1, 150) || '...' ELSE {0} END AS {0}"
    lab = ("SELECT 'labeled' AS type, claim_id, claim, ground_truth AS expected, final_verdict AS predicted, correct, "
           "escalated, text_key % 1000 * calls / 1000.0 AS time, a_confidence, b_confidence, judge_confidence AS "
           "ref_confidence FROM res WHERE ground_truth IS NOT NULL AND row_error IS NULL")
    con = ("SELECT 'contested_factual' AS type, claim_id, claim, a_prediction AS verifier_a, b_prediction AS verifier_b, "
           "final_prediction AS final, escalated, text_key % 1000 * calls / 1000.0 AS time, a_confidence, b_confidence, "
           f"judge_confidence AS ref_confidence, {short.format('a_reasoning')}, {short.format('b_reasoning')} "
           "FROM res WHERE ground_truth IS NULL AND row_error IS NULL")
    bad = ("SELECT CASE WHEN ground_truth IS NULL THEN 'contested_factual' ELSE 'labeled' END AS type, claim_id, claim, "
           "ground_truth AS expected, CASE WHEN ground_truth IS NOT NULL THEN FALSE END AS correct, FALSE AS escalated, "
           "row_error AS error FROM res WHERE row_error IS NOT NULL")
    summ = ("SELECT 'summary' AS type, avg(CASE WHEN ground_truth IS NOT NULL THEN CAST(correct AND row_error IS NULL "
            "AS INTEGER) END) AS labeled_accuracy, avg(CASE WHEN ground_truth IS NULL THEN CAST(escalated AND row_error "
            "IS NULL AS INTEGER) END) AS contested_factual_escalation_rate, CAST(sum(calls) AS BIGINT) AS "
            "total_model_calls FROM res")
    meta = (f"SELECT 'metadata' AS type, CAST({GAMMA} AS DOUBLE) AS gamma, 0 AS seed, 'verifier-a' AS model_a, "
            "'verifier-b' AS model_b, 'judge' AS model_referee, CAST(0.1 AS DOUBLE) AS temperature_a, "
            "CAST(0.9 AS DOUBLE) AS temperature_b, CAST(0 AS DOUBLE) AS temperature_referee, TRUE AS dated")
    return with_ctes(O.cascade_ctes(claims=O.claims_sql(), row_error=RECORD_ERROR_SQL),
                     " UNION ALL BY NAME ".join((meta, lab, con, bad, summ)))


def timed_verifier(role):
    return RuleVerifier(lambda claim: fixture_answer(role).withField("elapsed_ms", F.expr("CAST(text_key % 1000 AS DOUBLE)")))


@register("jsonl_records_full", _full_records_sql(), RECORD_DOUBLES)
def q_jsonl_records_full(spark, sf_dir):
    """All fields of all records of all documents, written as JSON Lines and read back."""
    claims = all_claims(spark, sf_dir).withColumn("row_error", F.expr(RECORD_ERROR_SQL))
    config = CascadeConfig(gamma=GAMMA)
    r = cascade(claims, *map(timed_verifier, ("a", "b", "judge")), config=config, row_error_col="row_error")
    back = K.write_evaluation(r, durable_path(spark, "records"), config)
    names = (("a", "verifier_a"), ("b", "verifier_b"), ("referee", "referee"))
    return back.select(*[c for c in back.columns if c not in ("timestamp", "models", "temperatures")],
                       *[F.col(f"models.{f}").alias(f"model_{n}") for n, f in names],
                       *[F.col(f"temperatures.{f}").alias(f"temperature_{n}") for n, f in names],
                       (F.col("timestamp") > 0).alias("dated"))


@register("save_results", with_ctes(
    O.cascade_ctes(), "SELECT claim_id, final_verdict, escalated, a_confidence, judge_verdict FROM res"),
    ("a_confidence",))
def q_save_results(spark, sf_dir):
    """A10: nested results as JSON Lines + metadata, read back (structs survive as JSON objects)."""
    path = durable_path(spark, "results")
    K.save_results(results(spark, sf_dir), path, gamma=GAMMA)
    back = spark.read.json(f"{path}/results")
    return back.select("claim_id", "final_verdict", "escalated", F.col("a.confidence").alias("a_confidence"),
                       F.col("judge.verdict").alias("judge_verdict"))


@register("run_manifest", with_ctes(O.cascade_ctes(), "SELECT claim_id, final_verdict FROM res"))
def q_run_manifest(spark, sf_dir):
    """Results partitioned by run id plus the run table; this run's rows read back (the id is random)."""
    base = durable_path(spark, "runs")
    t0 = time.time()
    rid = K.run_manifest(results(spark, sf_dir), base, {"gamma": GAMMA, "policy": "p1"}, {"mode": "single"},
                         started=t0)
    return spark.read.parquet(f"{base}/results").filter(F.col("run_id") == rid).select("claim_id", "final_verdict")


def _sweep_sql_cols():
    from verdictflow.plans.keys import SWEEP_COLS, sweep_sql
    return sweep_sql(select=f"SELECT pos, gamma, {', '.join(SWEEP_COLS)} FROM sw")


@register("save_sweep", _sweep_sql_cols(), ("gamma", "overall_accuracy", "escalated_accuracy", "non_escalated_accuracy",
                                            "escalation_rate", "disagreement_rate", "agreement_rate",
                                            "avg_calls_per_evaluation", "cost_per_correct", "false_consensus_rate",
                                            "precision", "recall", "f1_score", "efficiency"))
def q_save_sweep(spark, sf_dir):
    """The sweep as one CSV file, read back with the sweep's own schema."""
    from verdictflow.plans.keys import SWEEP_COLS, sweep_df
    path = durable_path(spark, "sweep") + ".csv"
    sw = sweep_df(spark, sf_dir).select("pos", "gamma", *SWEEP_COLS)
    K.save_sweep(sw, path)
    return spark.read.option("header", True).schema(sw.schema).csv(path)


def _run_log_sql():
    runs = ", ".join(f"r{i} AS (SELECT 'documents_gamma_{g}' AS dataset_name, n AS dataset_size, {O.derive_sql()} FROM ({O.sums_sql(f'g{i}_res')}) s)"
                     for i, g in enumerate((0.5, 0.9)))
    cols = "dataset_name, dataset_size, escalation_rate, overall_accuracy"
    ctes = ",\n".join(O.cascade_ctes(f"g{i}_", gamma=g) for i, g in enumerate((0.5, 0.9)))
    return with_ctes(f"{ctes},\n{runs}", f"SELECT {cols}, TRUE AS timed FROM r0 UNION ALL SELECT {cols}, TRUE FROM r1")


@register("run_log", _run_log_sql(), ("escalation_rate", "overall_accuracy"))
def q_run_log(spark, sf_dir):
    """Two evaluations appended to one run-log table, read back."""
    path = durable_path(spark, "runlog")
    for g in (0.5, 0.9):
        t0 = time.time()
        m = M.evaluation_metrics(results(spark, sf_dir, g)).select("total_evaluations", "escalation_rate",
                                                                   "overall_accuracy")
        n = m.first()["total_evaluations"]
        K.append_run_log(spark, path, f"documents_gamma_{g}", n, time.time() - t0, m)
    log = spark.read.parquet(path).withColumn("m", F.from_json("final_metrics", "escalation_rate double, overall_accuracy double"))
    return log.select("dataset_name", "dataset_size", "m.escalation_rate", "m.overall_accuracy",
                      (F.col("evaluation_time") > 0).alias("timed"))


# ----------------------------------------------------------------- J1, J2
EVENT_CLAIMS_SQL = ("SELECT event_id AS claim_id, concat_ws(' ', event_type, props) AS claim, "
                    "CAST(NULL AS VARCHAR) AS ground_truth, event_type, "
                    f"{O.text_key_sql("concat_ws(' ', event_type, props)")} AS text_key FROM events")


def _event_counters_sql():
    lab = "(ground_truth IS NOT NULL AND ground_truth <> '')"
    ok = f"({lab} AND coalesce(correct, FALSE))"
    c = (f"SELECT event_type, count(*) AS total_evaluations, "
         f"CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS escalations, "
         f"CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreements, "
         f"CAST(sum(CASE WHEN NOT agree THEN 1 ELSE 0 END) AS BIGINT) AS disagreements, "
         f"CAST(sum(CASE WHEN {ok} THEN 1 ELSE 0 END) AS BIGINT) AS correct_predictions, "
         f"CAST(sum(CASE WHEN {ok} AND escalated THEN 1 ELSE 0 END) AS BIGINT) AS correct_escalations, "
         f"CAST(sum(CASE WHEN {ok} AND NOT escalated THEN 1 ELSE 0 END) AS BIGINT) AS correct_non_escalations, "
         f"count(*) AS verifier_a_calls, count(*) AS verifier_b_calls, "
         f"CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS judge_calls FROM res GROUP BY event_type")
    d = O._div
    rates = ", ".join([
        f"{d('escalations', 'total_evaluations')} AS escalation_rate",
        f"{d('disagreements', 'total_evaluations')} AS disagreement_rate",
        f"{d('agreements', 'total_evaluations')} AS agreement_rate",
        f"{d('correct_predictions', 'total_evaluations')} AS overall_accuracy",
        f"{d('correct_escalations', 'escalations')} AS escalation_accuracy",
        f"{d('correct_non_escalations', 'total_evaluations - escalations')} AS non_escalation_accuracy",
        "verifier_a_calls + verifier_b_calls + judge_calls AS total_model_calls",
        f"{d('verifier_a_calls + verifier_b_calls + judge_calls', 'total_evaluations')} AS avg_calls_per_evaluation"])
    return with_ctes(O.cascade_ctes(claims=EVENT_CLAIMS_SQL) + f",\nc AS ({c})", f"SELECT *, {rates} FROM c")


EVENT_RATE_DOUBLES = ("escalation_rate", "disagreement_rate", "agreement_rate", "overall_accuracy",
                      "escalation_accuracy", "non_escalation_accuracy", "avg_calls_per_evaluation")


def _stream_paths(spark, name):
    base = durable_path(spark, name)
    return f"{base}/sink", f"{base}/checkpoint"


@register("stream_cascade", with_ctes(O.cascade_ctes(claims=EVENT_CLAIMS_SQL),
                                      "SELECT claim_id, event_type, escalated, final_verdict, reason FROM res"))
def q_stream_cascade(spark, sf_dir):
    """The cascade over the ``events`` table read as a stream; the micro-batch files read back."""
    from verdictflow.streaming.stream import event_claims, stream_cascade, stream_table
    a, b, j = fixture_verifiers()
    sink, ckpt = _stream_paths(spark, "stream_cascade")
    q = stream_cascade(event_claims(stream_table(spark, sf_dir, "events")).withColumn("text_key", text_key("claim")), a, b, j, sink, ckpt, truth_col=None)
    q.awaitTermination()
    return spark.read.parquet(sink).select("claim_id", "event_type", "escalated", "final_verdict", "reason")


@register("stream_counters", _event_counters_sql(), EVENT_RATE_DOUBLES)
def q_stream_counters(spark, sf_dir):
    """Running counters per event type over the streamed cascade results."""
    from verdictflow.streaming.stream import event_claims, read_counters, stream_counters, stream_table
    a, b, j = fixture_verifiers()
    sink, ckpt = _stream_paths(spark, "stream_counters")
    r = cascade(event_claims(stream_table(spark, sf_dir, "events")).withColumn("text_key", text_key("claim")), a, b, j, GAMMA, truth_col=None)
    q = stream_counters(r, sink, ckpt, by="event_type")
    q.awaitTermination()
    return read_counters(spark, sink, "event_type")


class _Crash(Exception):
    """Stands for a driver that is lost between a batch's write and Spark's note of it."""


def _crash_once(at):
    left = {at}

    def written(batch_id):
        if batch_id in left:
            left.clear()
            raise _Crash(f"lost after batch {batch_id}")
    return written


def _event_files(spark, sf_dir, name, files=4):
    """The events as a stream of several files, one per trigger, each dealt out over all cores."""
    from verdictflow.streaming.stream import dealt
    path = durable_path(spark, name) + "/events"
    table(spark, sf_dir, "events").repartition(files, "event_id").write.parquet(path)
    return dealt(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path))


def _until_done(start):
    """Runs a stream that crashes once, and resumes it from its checkpoint."""
    try:
        start().awaitTermination()
    except Exception as e:  # noqa: BLE001 - Spark wraps what the batch raised
        if "lost after batch" not in str(e):
            raise
        start().awaitTermination()
        return
    raise AssertionError("the stream did not crash")


@register("stream_cascade_restart", with_ctes(O.cascade_ctes(claims=EVENT_CLAIMS_SQL),
                                              "SELECT claim_id, event_type, escalated, final_verdict, reason FROM res"))
def q_stream_cascade_restart(spark, sf_dir):
    """Several micro-batches; the second is repeated after a crash between its write and its commit."""
    from verdictflow.streaming.stream import event_claims, stream_cascade
    a, b, j = fixture_verifiers()
    sink, ckpt = _stream_paths(spark, "stream_cascade_restart")
    events, crash = _event_files(spark, sf_dir, "stream_cascade_restart"), _crash_once(1)
    claims = event_claims(events).withColumn("text_key", text_key("claim"))
    _until_done(lambda: stream_cascade(claims, a, b, j, sink, ckpt, truth_col=None, written=crash))
    return spark.read.parquet(sink).select("claim_id", "event_type", "escalated", "final_verdict", "reason")


@register("stream_counters_restart", _event_counters_sql(), EVENT_RATE_DOUBLES)
def q_stream_counters_restart(spark, sf_dir):
    """Counters of several micro-batches, of which one is repeated after a crash."""
    from verdictflow.streaming.stream import event_claims, read_counters, stream_counters
    a, b, j = fixture_verifiers()
    sink, ckpt = _stream_paths(spark, "stream_counters_restart")
    events, crash = _event_files(spark, sf_dir, "stream_counters_restart"), _crash_once(2)
    r = cascade(event_claims(events).withColumn("text_key", text_key("claim")), a, b, j, GAMMA, truth_col=None)
    _until_done(lambda: stream_counters(r, sink, ckpt, by="event_type", output_mode="update", written=crash))
    return read_counters(spark, sink, "event_type")


# ----------------------------------------------------------------- A1 - A3, D1, D14/F21, I1
def _written(spark, sf_dir, suffix):
    """Labelled claims written by Spark in a reference file format, to be read back."""
    path = durable_path(spark, "claims") + suffix
    K.save_dataset(labelled_claims(spark, sf_dir).withColumnRenamed("ground_truth", "label"), path)
    return path


CLAIM_LABEL_SQL = with_ctes(f"c AS ({O.labelled_claims_sql()})", "SELECT claim, ground_truth AS label FROM c")


@register("read_csv", CLAIM_LABEL_SQL)
def q_read_csv(spark, sf_dir):
    return D.read_csv(spark, _written(spark, sf_dir, ".csv")).select("claim", "label")


def _udf_answers():
    """A and the judge are the in-process rule model (yes iff the whole text has even length)."""
    cols = []
    for p in ("a", "j"):
        cols += [f"CASE WHEN length(claim) % 2 = 0 THEN 'yes' ELSE 'no' END AS {p}_v", f"'checked by rule' AS {p}_r",
                 f"'0.95' AS {p}_c", f"CAST(NULL AS VARCHAR) AS {p}_e", f"CAST(NULL AS VARCHAR) AS {p}_o"]
    return (f"SELECT *, {', '.join(cols)}, {O.answers_cols(roles=(('b', 1),))}, "
            f"CAST(NULL AS VARCHAR) AS b_o FROM claims")


@register("verifier_udf", with_ctes(O.cascade_ctes(answers=_udf_answers(), raw_given=True),
                                    f"SELECT {O.FLAT_COLS} FROM res"),
          ("a_confidence", "b_confidence", "judge_confidence", "min_confidence"))
def q_verifier_udf(spark, sf_dir):
    """A and the judge through the Arrow pandas UDF over the whole document texts."""
    from verdictflow.operators.clients import RuleClient
    from verdictflow.operators.verifiers import ModelVerifier
    from verdictflow.plans.keys import flat_cols
    from verdictflow.sources.derived import fixture_verifier
    a, j = ModelVerifier(RuleClient), ModelVerifier(RuleClient)
    return cascade(document_claims(spark, sf_dir), a, fixture_verifier("b"), j, GAMMA).select(*flat_cols())


@register("model_timing", f"SELECT lang, count(*) AS claims, CAST(sum(CASE WHEN claim IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS "
                         f"timed, CAST(0 AS BIGINT) AS errors FROM ({O.claims_sql()}) c GROUP BY lang")
def q_model_timing(spark, sf_dir):
    """How many claims have a time of their call, and how many ran into an error (times vary run to run)."""
    from verdictflow.operators.clients import RuleClient
    from verdictflow.operators.verifiers import ModelVerifier
    mv = ModelVerifier(RuleClient)
    d = mv.answers(document_claims(spark, sf_dir), "m", F.col("claim"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("m.elapsed_ms") >= 0).alias("timed"),
                                 F.count_if(F.col("m.error").isNotNull()).alias("errors"))


def _ablation_sql():
    cols = "pos, gamma, overall_accuracy, escalation_rate, avg_calls_per_evaluation, efficiency"
    best = (f"(SELECT 'best_accuracy' AS config, {cols} FROM sw ORDER BY overall_accuracy DESC, pos LIMIT 1) "
            f"UNION ALL (SELECT 'best_efficiency' AS config, {cols} FROM sw "
            f"ORDER BY overall_accuracy / avg_calls_per_evaluation DESC, pos LIMIT 1) "
            f"UNION ALL (SELECT 'lowest_cost' AS config, {cols} FROM sw ORDER BY avg_calls_per_evaluation, pos LIMIT 1)")
    bal = ("SELECT CAST(sum(CASE WHEN ground_truth = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS positive, "
           "CAST(sum(CASE WHEN ground_truth = 'no' THEN 1 ELSE 0 END) AS BIGINT) AS negative, count(*) AS size "
           f"FROM ({O.claims_sql(False)}) c")
    from verdictflow.plans.keys import sweep_sql
    return sweep_sql(select=f"SELECT * FROM ({best}) b, ({bal}) k")


@register("ablation", _ablation_sql(), ("gamma", "overall_accuracy", "escalation_rate", "avg_calls_per_evaluation",
                                        "efficiency"))
def q_ablation(spark, sf_dir):
    """Sweep -> the three optimal configurations, with the dataset's size and balance."""
    from verdictflow.plans.report import ablation
    a, b, j = fixture_verifiers()
    return ablation(document_claims(spark, sf_dir), a, b, j, GAMMAS)


@register("stream_counters_update", _event_counters_sql(), EVENT_RATE_DOUBLES)
def q_stream_counters_update(spark, sf_dir):
    """J2, update mode: only changed groups are written per batch; the latest row per group is read back."""
    from verdictflow.streaming.stream import event_claims, read_counters, stream_counters, stream_table
    a, b, j = fixture_verifiers()
    sink, ckpt = _stream_paths(spark, "stream_counters_update")
    r = cascade(event_claims(stream_table(spark, sf_dir, "events")).withColumn("text_key", text_key("claim")), a, b, j, GAMMA, truth_col=None)
    stream_counters(r, sink, ckpt, by="event_type", output_mode="update").awaitTermination()
    return read_counters(spark, sink, "event_type")
