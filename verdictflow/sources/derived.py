"""Claims and fixture model answers derived from the driver tables.

The driver tables hold no claims or model answers, so tests and benchmarks
use a *derived verdict relation*: claims are ``documents``, with the truth of ``labels``
(``quality``) where there is one, and each role's answer is picked from fixed phrase
lists by a checksum of the whole claim text, together with a sentence of the claim.
The same recipe is written in DuckDB SQL for the oracle, so both engines see
identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions.parsing import ident, lit
from verdictflow.operators.verifiers import RuleVerifier

# Phrase lists of the derived verdict relation (test fixture): every branch of the parsers is met.
FIXTURE_VERDICTS = (
    "yes", "no", "Yes - the sources agree", "no: two dates differ", "that is TRUE", "Valid as stated",
    "mixed picture", "incorrect.", "Invalid", "valid", "untrue at best", "certainly not true", "open question",
    "yes; no contrary source", "will not say", "maybe", "", "\tYes\n", "true, true, no", "False - not correct",
)
FIXTURE_REASONINGS = (
    "", "about 80% confident after a second look", "the wording is definitely accurate", "it might rest on a typo",
    "uncertain without the table", "not sure the place exists", "an unlikely reading", "2% confident", "0.4% sure",
    "3.4.5% confident", "a doubtful source", "this could be a copy", "I believe the date", "wrong year, incorrect",
    "no further remark", "probability near 60%", "extremely close match",
)
ROLE_INDEX = {"a": 0, "b": 1, "judge": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(col: str) -> Column:
    """A number that depends on the whole text."""
    return F.expr(f"CAST(conv(substr(md5(coalesce({col}, '')), 1, 7), 16, 10) AS BIGINT)")


def document_claims(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Every document as a claim, with an optional truth.

    ``claim_id`` = doc_id, ``claim`` = the whole document text, ``ground_truth`` = 'yes' where
    ``quality = 1``, 'no' for another label, NULL where none is given; ``lang`` and ``source`` pass
    through. The fixture verifiers answer by ``text_key``. Repeated labels of a document count once
    ('yes' if any says so), so a document is one claim.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    truth = F.when(F.col("quality") == 1, F.lit("yes")).when(F.col("quality").isNotNull(), F.lit("no"))
    text = [F.col("text").alias("claim")] if with_text else []
    return docs.select(F.col("doc_id").alias("claim_id"), *text, truth.alias("ground_truth"), "lang", "source",
                       text_key("text").alias("text_key"))


def all_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_claims(spark, sf_dir)


def labelled_claims(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """The claims that have a truth: for data sets whose format requires a label."""
    return document_claims(spark, sf_dir, with_text).filter(F.col("ground_truth").isNotNull())


def fixture_answer_sql(role, key: str, errors: bool = False) -> str:
    """Raw answer of role x (0=a, 1=b, 2=judge) for claim key ``key`` (SQL; FIXTURES.md F-6).

    ``role`` is a role name, an index, or SQL text for the index (``expr:x``). The reasoning is a phrase
    and a sentence of the column ``claim``, another one for each role, so that parsers meet table text.
    ``errors=True`` injects failed calls: ``error='timeout'`` when
    ``(key + x) % 7 = 3`` and a missing verdict when ``(key + x) % 11 = 5``.
    """
    if isinstance(role, str) and role.startswith("expr:"):
        x = f"({role[5:]})"
    else:
        x = str(ROLE_INDEX[role] if isinstance(role, str) else int(role))
    verdicts = "array(" + ", ".join(lit(v) for v in FIXTURE_VERDICTS) + ")"
    reasonings = "array(" + ", ".join(lit(v) for v in FIXTURE_REASONINGS) + ")"
    verdict = f"element_at({verdicts}, CAST(({key} * (2 * {x} + 1) + 3 * {x}) % 20 + 1 AS INT))"
    reasoning = f"element_at({reasonings}, CAST(({key} * (2 * {x} + 3) + 5 * {x}) % 17 + 1 AS INT))"
    sentences = "split(coalesce(claim, ''), '\\\\.')"
    reasoning = f"concat({reasoning}, ' ', element_at({sentences}, CAST(({key} + {x}) % size({sentences}) + 1 AS INT)))"
    conf = f"CASE ({key} + {x}) % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '0.55' WHEN 2 THEN 'x%' END"
    err = "CAST(NULL AS STRING)"
    if errors:
        err = f"CASE WHEN ({key} + {x}) % 7 = 3 THEN 'timeout' END"
        verdict = f"CASE WHEN ({key} + {x}) % 11 = 5 THEN CAST(NULL AS STRING) ELSE {verdict} END"
    return (f"named_struct('verdict', {verdict}, 'confidence', {conf}, 'reasoning', {reasoning}, "
            f"'raw_output', CAST(NULL AS STRING), "
            f"'error', {err}, 'elapsed_ms', CAST(NULL AS DOUBLE))")


def fixture_answer(role, key: str = "text_key", errors: bool = False) -> Column:
    return F.expr(fixture_answer_sql(role, ident(key), errors))


def role_answers(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    """Every document x every role with its fixture raw answer: ``claim_id, x, role, raw``."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"),
                                                 text_key("text").alias("text_key"))
    d = d.select("claim_id", "claim", "text_key", F.expr("explode(array(0, 1, 2)) AS x"))
    return d.select("claim_id", "x", F.expr("CASE x WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'judge' END AS role"),
                    F.expr(fixture_answer_sql("expr:x", "text_key", errors)).alias("raw"))


def fixture_verifier(role: str | int, key_col: str = "text_key", errors: bool = False) -> RuleVerifier:
    """D3 rule verifier answering with the derived relation for ``role``."""
    return RuleVerifier(lambda claim: fixture_answer(role, key_col, errors), name=f"fixture_{role}")


def fixture_verifiers(key_col: str = "text_key", errors: bool = False):
    return tuple(fixture_verifier(r, key_col, errors) for r in ("a", "b", "judge"))


def fixture_outputs(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Precomputed answers of one role for every document (input of a TableVerifier, D4)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"),
                                                 text_key("text").alias("text_key"))
    return d.select("claim_id", fixture_answer(role).alias("r")).select("claim_id", "r.*")
