"""Keys for the parsers (C1-C14) and the cascade variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictflow.functions import parsing as P
from verdictflow.functions.bands import BAND_SCHEMES, escalation_band
from verdictflow.operators.answers import AnswerStore, StoredCascade
from verdictflow.operators.cascade import cascade, forced_disagreement
from verdictflow.operators.verifiers import RuleVerifier, TableVerifier, constant_verifier, raw_answer
from verdictflow.plans import oracle as O
from verdictflow.plans.keys import FLAT_DOUBLES, GAMMA, flat_cols, results
from verdictflow.plans.registry import register, with_ctes
from verdictflow.session import durable_path
from verdictflow.sources.derived import (document_claims, fixture_answer_sql, fixture_outputs, fixture_verifier, role_answers,
                                         table)


def parsed(spark, sf_dir, policy="p1", errors=False):
    return P.parse_role(role_answers(spark, sf_dir, errors), "raw", "r", policy)


# ----------------------------------------------------------------- C1 - C11
@register("normalize_verdict", with_ctes(O.parse_input_ctes(),
                                         "SELECT claim_id, role, r_v AS verdict_text, r_verdict AS verdict FROM parsed"))
def q_normalize_verdict(spark, sf_dir):
    return parsed(spark, sf_dir).select("claim_id", "role", F.col("raw.verdict").alias("verdict_text"),
                                        F.col("r.verdict").alias("verdict"))


@register("verdict_quality", with_ctes(
    O.parse_input_ctes(policy=None),
    f"SELECT claim_id, role, ({O._any('lower(r_v)', O.YES_WORDS)} AND {O._any('lower(r_v)', O.NO_WORDS)}) AS conflict, "
    f"(NOT {O._any('lower(r_v)', O.YES_WORDS)} AND NOT {O._any('lower(r_v)', O.NO_WORDS)}) AS ambiguous FROM parsed"))
def q_verdict_quality(spark, sf_dir):
    return role_answers(spark, sf_dir).select("claim_id", "role", P.verdict_conflict("expr:raw.verdict").alias("conflict"),
                                              P.verdict_ambiguous("expr:raw.verdict").alias("ambiguous"))


@register("failed_output_default", with_ctes(
    O.parse_input_ctes(errors=True),
    "SELECT claim_id, role, r_verdict AS verdict, r_prediction AS prediction, r_confidence AS confidence, "
    "r_reasoning AS reasoning, r_e AS error FROM parsed"), ("confidence",))
def q_failed_output_default(spark, sf_dir):
    return parsed(spark, sf_dir, errors=True).select(
        "claim_id", "role", F.col("r.verdict").alias("verdict"), F.col("r.prediction").alias("prediction"),
        F.col("r.confidence").alias("confidence"), F.col("r.reasoning").alias("reasoning"),
        F.col("r.error").alias("error"))


@register("parse_strict", with_ctes(
    O.parse_input_ctes(errors=True, policy="p2"),
    "SELECT claim_id, role, r_prediction AS prediction, r_confidence AS confidence, r_reasoning AS reasoning "
    "FROM parsed"), ("confidence",))
def q_parse_strict(spark, sf_dir):
    return parsed(spark, sf_dir, "p2", errors=True).select(
        "claim_id", "role", F.col("r.prediction").alias("prediction"), F.col("r.confidence").alias("confidence"),
        F.col("r.reasoning").alias("reasoning"))


@register("parse_coinflip", with_ctes(
    O.parse_input_ctes(errors=True, policy="p3"),
    "SELECT claim_id, role, r_verdict AS verdict, r_prediction AS prediction FROM parsed"))
def q_parse_coinflip(spark, sf_dir):
    return parsed(spark, sf_dir, "p3", errors=True).select(
        "claim_id", "role", F.col("r.verdict").alias("verdict"), F.col("r.prediction").alias("prediction"))


@register("parse_biased", with_ctes(
    O.parse_input_ctes(errors=True, policy=None),
    f"SELECT claim_id, role, coalesce({O.strict_verdict_sql('r')}, 'yes') AS yes_biased, "
    f"coalesce({O.strict_verdict_sql('r')}, 'no') AS no_biased FROM parsed"))
def q_parse_biased(spark, sf_dir):
    d = role_answers(spark, sf_dir, errors=True)
    return d.select("claim_id", "role", P.parse_biased("raw", "yes")["verdict"].alias("yes_biased"),
                    P.parse_biased("raw", "no")["verdict"].alias("no_biased"))


@register("confidence_structured", with_ctes(
    O.parse_input_ctes(),
    "SELECT claim_id, role, r_c AS confidence_text, r_conf_structured AS value FROM parsed"), ("value",))
def q_confidence_structured(spark, sf_dir):
    return role_answers(spark, sf_dir).select("claim_id", "role", F.col("raw.confidence").alias("confidence_text"),
                                              P.confidence_structured("expr:raw.confidence").alias("value"))


def _search_text(spark, sf_dir):
    d = parsed(spark, sf_dir)
    return d.withColumn("text", P.confidence_text("expr:r.reasoning", "expr:r.raw_output"))


@register("confidence_percent", with_ctes(O.parse_input_ctes(),
                                          "SELECT claim_id, role, r_conf_percent AS value FROM parsed"), ("value",))
def q_confidence_percent(spark, sf_dir):
    return _search_text(spark, sf_dir).select("claim_id", "role",
                                                            P.confidence_percent("text").alias("value"))


@register("confidence_lexicon", with_ctes(O.parse_input_ctes(),
                                          "SELECT claim_id, role, r_conf_lexicon AS value FROM parsed"), ("value",))
def q_confidence_lexicon(spark, sf_dir):
    return _search_text(spark, sf_dir).select("claim_id", "role",
                                                            P.confidence_lexicon("text").alias("value"))


@register("confidence_full", with_ctes(
    O.parse_input_ctes(errors=True),
    "SELECT claim_id, role, r_verdict AS verdict, r_confidence AS confidence FROM parsed"), ("confidence",))
def q_confidence_full(spark, sf_dir):
    return parsed(spark, sf_dir, errors=True).select("claim_id", "role", F.col("r.verdict").alias("verdict"),
                                                     F.col("r.confidence").alias("confidence"))


def _turn_sql():
    """Assistant turns of ``conversations`` read as model answers (verdict = reasoning = raw = whole text)."""
    pin = ("SELECT conv_id, turn, text AS r_v, text AS r_r, CAST(NULL AS VARCHAR) AS r_c, CAST(NULL AS VARCHAR) AS r_e, "
           "text AS r_o FROM conversations WHERE role = 'assistant'")
    ctes = [f"pin AS ({pin})"]
    prev = "pin"
    for i, st in enumerate(O.p1_stages("r")):
        ctes.append(f"ps{i} AS (SELECT *, {st} FROM {prev})")
        prev = f"ps{i}"
    return with_ctes(",\n".join(ctes), f"SELECT conv_id, turn, r_verdict AS verdict, r_confidence AS confidence, "
                                       f"length(r_v) AS n_chars FROM {prev}")


@register("parse_conversation_turns", _turn_sql(), ("confidence",))
def q_parse_conversation_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    c = c.select("conv_id", "turn", raw_answer(F.col("text"), None, F.col("text"), F.col("text")).alias("raw"),
                 F.length("text").cast("bigint").alias("n_chars"))
    return P.parse_role(c, "raw", "r").select("conv_id", "turn", F.col("r.verdict").alias("verdict"),
                                              F.col("r.confidence").alias("confidence"), "n_chars")


# ----------------------------------------------------------------- C12 - C14
@register("pair_confidence", with_ctes(O.cascade_ctes(),
                                       "SELECT claim_id, min_confidence, mean_confidence FROM res"),
          ("min_confidence", "mean_confidence"))
def q_pair_confidence(spark, sf_dir):
    return results(spark, sf_dir).select("claim_id", "min_confidence", "mean_confidence")


@register("escalation_band", with_ctes(
    O.cascade_ctes(),
    "SELECT lang, escalation_rate, " + ", ".join(f"{sql.format(r='escalation_rate')} AS {s}" for s, sql in O.BANDS.items()) +
    " FROM (SELECT lang, avg(CASE WHEN escalated THEN 1.0 ELSE 0.0 END) AS escalation_rate FROM res GROUP BY lang) x"),
    ("escalation_rate",))
def q_escalation_band(spark, sf_dir):
    r = results(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("escalated").cast("double")).alias("escalation_rate"))
    return r.select("lang", "escalation_rate", *[escalation_band("escalation_rate", s).alias(s) for s in BAND_SCHEMES])


# ----------------------------------------------------------------- D3 - D15
def _const_answers():
    """Mocks of the reference tests: A and B always 'yes', judge always 'no', nothing else."""
    cols = []
    for p, v in (("a", "yes"), ("b", "yes"), ("j", "no")):
        cols += [f"'{v}' AS {p}_v", f"CAST(NULL AS VARCHAR) AS {p}_r", f"CAST(NULL AS VARCHAR) AS {p}_c",
                 f"CAST(NULL AS VARCHAR) AS {p}_e", f"CAST(NULL AS VARCHAR) AS {p}_o"]
    return "SELECT *, " + ", ".join(cols) + " FROM claims"


@register("rule_verifier", with_ctes(O.cascade_ctes(answers=_const_answers(), raw_given=True),
                                     f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_rule_verifier(spark, sf_dir):
    a, b, j = constant_verifier("yes"), constant_verifier("yes"), constant_verifier("no")
    return cascade(document_claims(spark, sf_dir), a, b, j, GAMMA).select(*flat_cols())


@register("precomputed_verdicts", with_ctes(O.cascade_ctes(), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_precomputed_verdicts(spark, sf_dir):
    a, b, j = (TableVerifier(fixture_outputs(spark, sf_dir, r), name=f"table_{r}") for r in ("a", "b", "judge"))
    return cascade(document_claims(spark, sf_dir), a, b, j, GAMMA).select(*flat_cols())


def text_rule():
    """A rule model over the whole (possibly prefixed) claim text: ' not ' -> no, ' the ' -> yes, else unclear."""
    return RuleVerifier(lambda claim: raw_answer(
        F.when(F.lower(claim).contains(" not "), F.lit("no")).when(F.lower(claim).contains(" the "), F.lit("yes"))
        .otherwise(F.lit("unclear"))), name="text_rule")


LEANINGS = ("Be generous: ", "Be strict: ")


def _text_rule_sql(prefix):
    t = f"lower({O.q(prefix)} || claim)"
    return f"CASE WHEN contains({t}, ' not ') THEN 'no' WHEN contains({t}, ' the ') THEN 'yes' ELSE 'unclear' END"


def _forced_answers():
    cols = []
    for p, prefix in zip("ab", LEANINGS, strict=True):
        cols += [f"{_text_rule_sql(prefix)} AS {p}_v", f"CAST(NULL AS VARCHAR) AS {p}_r",
                 f"CAST(NULL AS VARCHAR) AS {p}_c", f"CAST(NULL AS VARCHAR) AS {p}_e",
                 f"CAST(NULL AS VARCHAR) AS {p}_o"]
    return f"SELECT *, {', '.join(cols)}, {O.answers_cols(roles=(('j', 2),))} FROM claims"


def _forced_ctes():
    # A and B answer with the text rule on their prefixed claim; the judge is the fixture judge (P3 parser)
    return O.cascade_ctes(answers=_forced_answers(), policy="p3", parsers=("biased", "biased", "p3"),
                          biases=("yes", "no"), gamma=0.0, raw_given=True)


@register("forced_disagreement", with_ctes(
    _forced_ctes(), "SELECT claim_id, lang, a_verdict, b_verdict, judge_verdict, escalated, final_verdict, correct "
                    "FROM res"))
def q_forced_disagreement(spark, sf_dir):
    r = forced_disagreement(document_claims(spark, sf_dir), text_rule(), fixture_verifier("judge"), prefixes=LEANINGS)
    return r.select("claim_id", "lang", F.col("a.verdict").alias("a_verdict"), F.col("b.verdict").alias("b_verdict"),
                    F.col("judge.verdict").alias("judge_verdict"), "escalated", "final_verdict", "correct")


@register("biased_verifiers", with_ctes(
    _forced_ctes(), "SELECT lang, count(*) AS claims, "
                    "CAST(sum(CASE WHEN a_verdict = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS a_yes, "
                    "CAST(sum(CASE WHEN b_verdict = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS b_yes, "
                    "CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS escalations FROM res GROUP BY lang"))
def q_biased_verifiers(spark, sf_dir):
    r = forced_disagreement(document_claims(spark, sf_dir), text_rule(), fixture_verifier("judge"), prefixes=LEANINGS)
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("claims"),
                                 F.count_if(F.col("a.verdict") == "yes").alias("a_yes"),
                                 F.count_if(F.col("b.verdict") == "yes").alias("b_yes"),
                                 F.count_if("escalated").alias("escalations"))


@register("escalation_gate", with_ctes(O.cascade_ctes(),
                                       "SELECT claim_id, agree, min_confidence, gamma, escalated FROM res"),
          ("min_confidence", "gamma"))
def q_escalation_gate(spark, sf_dir):
    return results(spark, sf_dir).select("claim_id", "agree", "min_confidence", "gamma", "escalated")


GAMMA_COL_SQL = "0.5 + (claim_id % 5) * 0.1"


@register("escalation_gate_p2", with_ctes(O.cascade_ctes(policy="p2", gamma=GAMMA_COL_SQL),
                                          "SELECT claim_id, gamma, agree, min_confidence, escalated, reason FROM res"),
          ("gamma", "min_confidence"))
def q_escalation_gate_p2(spark, sf_dir):
    return results(spark, sf_dir, F.expr(GAMMA_COL_SQL), "p2").select(
        "claim_id", "gamma", "agree", "min_confidence", "escalated", "reason")


@register("escalation_gate_p3", with_ctes(O.cascade_ctes(policy="p3"),
                                          "SELECT claim_id, a_verdict, b_verdict, agree, escalated FROM res"))
def q_escalation_gate_p3(spark, sf_dir):
    return results(spark, sf_dir, policy="p3").select("claim_id", F.col("a.verdict").alias("a_verdict"),
                                                      F.col("b.verdict").alias("b_verdict"), "agree", "escalated")


@register("escalation_reason", with_ctes(O.cascade_ctes(),
                                         "SELECT lang, reason, count(*) AS claims FROM res GROUP BY lang, reason"))
def q_escalation_reason(spark, sf_dir):
    return results(spark, sf_dir).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("claims"))


@register("judge_escalated", with_ctes(
    O.cascade_ctes(), "SELECT lang, CAST(sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS escalated, "
                      "count(judge_verdict) AS judge_answers, count(*) AS claims FROM res GROUP BY lang"))
def q_judge_escalated(spark, sf_dir):
    return results(spark, sf_dir).groupBy("lang").agg(F.count_if("escalated").alias("escalated"),
                                                      F.count("judge.verdict").alias("judge_answers"),
                                                      F.count(F.lit(1)).alias("claims"))


@register("cascade_final", with_ctes(
    O.cascade_ctes(), "SELECT claim_id, escalated, a_prediction, judge_prediction, final_prediction, final_verdict "
                      "FROM res"))
def q_cascade_final(spark, sf_dir):
    return results(spark, sf_dir).select("claim_id", "escalated", F.col("a.prediction").alias("a_prediction"),
                                         F.col("judge.prediction").alias("judge_prediction"), "final_prediction",
                                         "final_verdict")


ROW_ERROR_SQL = "CASE WHEN claim_id % 23 = 0 THEN 'upstream failure' END"


@register("fallback_rows", with_ctes(O.cascade_ctes(row_error=ROW_ERROR_SQL), f"SELECT {O.FLAT_COLS} FROM res"),
          FLAT_DOUBLES)
def q_fallback_rows(spark, sf_dir):
    from verdictflow.sources.derived import fixture_verifiers
    a, b, j = fixture_verifiers()
    c = document_claims(spark, sf_dir).withColumn("row_error", F.expr(ROW_ERROR_SQL))
    return cascade(c, a, b, j, GAMMA, row_error_col="row_error").select(*flat_cols())


@register("cascade_errors", with_ctes(O.cascade_ctes(errors=True), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_cascade_errors(spark, sf_dir):
    """C3 inside the cascade: failed and missing answers become 'no' with the default chain."""
    from verdictflow.sources.derived import fixture_verifiers
    a, b, j = fixture_verifiers(errors=True)
    return cascade(document_claims(spark, sf_dir), a, b, j, GAMMA).select(*flat_cols())



@register("precomputed_answers_long", with_ctes(O.cascade_ctes(), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_precomputed_answers_long(spark, sf_dir):
    """D4 at scale: all roles' stored answers (long table) attached with one join on the key."""
    from verdictflow.operators.verifiers import join_answers
    out = role_answers(spark, sf_dir).select("claim_id", "role", "raw.*")
    c, (a, b, j) = join_answers(document_claims(spark, sf_dir), out)
    return cascade(c, a, b, j, GAMMA).select(*flat_cols())


# ----------------------------------------------------------------- D1, D4, D12 over stored answers
def _stored(spark, sf_dir, name):
    """The cascade over a new answer store; the fixture answers stand for models that see the text only."""
    key = "CAST(conv(substr(md5(coalesce(claim, '')), 1, 7), 16, 10) AS BIGINT)"
    a, b, j = (RuleVerifier(lambda claim, r=r: F.expr(fixture_answer_sql(r, key)), name=f"fixture_{r}") for r in ("a", "b", "judge"))
    store = AnswerStore(spark, durable_path(spark, name))
    return StoredCascade(document_claims(spark, sf_dir), a, b, j, store, GAMMA)


@register("stored_cascade", with_ctes(O.cascade_ctes(), f"SELECT {O.FLAT_COLS} FROM res"), FLAT_DOUBLES)
def q_stored_cascade(spark, sf_dir):
    """Nine tenths of the claims are answered by an earlier run; this one asks about the others."""
    every = _stored(spark, sf_dir, "answers")
    every.where("claim_id % 10 <> 0").results()
    return every.results().select(*flat_cols())


@register("stored_gate", with_ctes(O.cascade_ctes(), "SELECT claim_id, lang, min_confidence, reason FROM res WHERE lang = 'de' "
                                                     "AND escalated"), ("min_confidence",))
def q_stored_gate(spark, sf_dir):
    """The gate alone, of the claims of one language: no judge is asked."""
    gate = _stored(spark, sf_dir, "gate-answers").where("lang = 'de'").gate()
    return gate.filter("escalated").select("claim_id", "lang", "min_confidence", "reason")
