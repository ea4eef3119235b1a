"""A store of model answers by content, and the cascade over it.

The store is a folder of Parquet in shared storage, one row per answer: the SHA-256 of the text that
the model was sent, the role, the model, and the answer. A claim is looked up by the digest of its
text, so equal claims are asked about once, under any id and in any later run; only texts without an
answer go to a model, and their answers are appended. An answer with an error counts as none: the
text is asked again. A write that is lost before Spark commits it leaves no answers behind, a write
repeated after a lost acknowledgement leaves some twice; of several answers of a text one is read (the
order is that of ``verifiers.one_answer``), so a claim never gives several rows.

:class:`StoredCascade` plans the cascade as two relations: the gate rows, from the claims and the
stored answers of the two verifiers, and the judge's stored answers, joined by digest. Building the
gate asks the verifiers, building the results asks the judge, each about the rows that are left after
``where()``. The plans read stored answers only: filters on claim columns reach the claims' scan, and
the judge's relation is not read where nothing of it is selected.

Answers are joined by digests that are computed once, before anything moves, so that a plan moves a
text at most once for all of its answers, and not at all where the text is not selected. What is left
to be asked is found among digests; texts move once to be asked, and a Bloom filter of fixed size
keeps most of the others where they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators.cascade import DECISION_COLUMNS, cascade
from verdictflow.operators.verifiers import RAW_FIELDS, PrefixedVerifier, TableVerifier, Verifier, constant_verifier
from verdictflow.session import materialize

FIELDS = ("verdict string, confidence string, reasoning string, raw_output string, error string, elapsed_ms double")
SCHEMA = f"digest string, {FIELDS}, role string, model string"


BLOOM = 17  # log2 of the number of 64-bit words of the filter: 1 MB, whatever the data


def digest_of(text: Column) -> Column:
    """The content address of a text; NULL has none."""
    return F.sha2(text, 256)


def perhaps_among(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` without most of those whose digest is not among ``digests``; the others all stay."""
    place = F.xxhash64("digest")
    word, spot = F.pmod(place, F.lit(1 << BLOOM)).cast("int"), F.pmod(F.shiftright(place, BLOOM), F.lit(64)).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), spot + 1)
    bloom = digests.select(word.alias("__word"), bit.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    return (rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(bloom), "__word")
            .filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*rows.columns))


class AnswerStore:
    """Answers in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def rows(self, role: str | None = None, model: str | None = None) -> DataFrame:
        """All stored answers, or those of a role and model (folders of their own, so others are not read)."""
        if not self.exists():
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).parquet(self.path)
        if role is not None:
            found = found.filter(F.col("role") == role)
        return found if model is None else found.filter(F.col("model") == model)

    def unanswered(self, texts: DataFrame, role: str, model: str, text_col: str = "claim",
                   among: DataFrame | None = None) -> DataFrame:
        """digest, claim: each distinct text without a usable stored answer, once; only those of the
        digests ``among`` (column digest), if given.

        The digests left are found first. Copies are merged before they move, and the exact join uses
        the partitioning of that step.
        """
        rows = (texts.filter(F.col(text_col).isNotNull())
                .select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).alias("claim")))
        known = self.rows(role, model).filter("error IS NULL").select("digest")
        if among is None and known.isEmpty():
            return rows.groupBy("digest").agg(F.first("claim").alias("claim"))
        new = (rows if among is None else among).select("digest").distinct().join(known, "digest", "left_anti")
        if among is not None:
            new = materialize(new, "answers-asked")  # read twice
        distinct = perhaps_among(rows, new).groupBy("digest").agg(F.first("claim").alias("claim"))
        return distinct.join(known, "digest", "left_anti") if among is None else distinct.join(new, "digest", "left_semi")

    def ask(self, texts: DataFrame, role: str, verifier: Verifier, text_col: str = "claim",
            among: DataFrame | None = None) -> None:
        """Asks ``verifier`` about the unanswered texts (with the digests ``among``, if given) and appends its answers."""
        prefix, inner = sent_by(verifier)
        sent = texts.select(F.concat(F.lit(prefix), F.col(text_col)).alias("claim")) if prefix else texts
        new = self.unanswered(sent, role, inner.name, "claim" if prefix else text_col, among)
        answers = inner.answers(new, "raw", F.col("claim")).select(
            "digest", *[F.col(f"raw.{c}").alias(c) for c in RAW_FIELDS], F.lit(role).alias("role"), F.lit(inner.name).alias("model"))
        answers.write.mode("append").partitionBy("role", "model").parquet(self.path)

    def verifier(self, role: str, verifier: Verifier) -> Verifier:
        """The stored answers of ``verifier`` in ``role`` as a verifier of their own; it asks no model."""
        return StoredAnswers(self, role, verifier)

    def compact(self, path: str) -> "AnswerStore":
        """A store at ``path`` with one answer per text, role and model, in fewer files."""
        from verdictflow.operators.verifiers import one_answer, stored_answer

        every = self.rows()
        kept = every.groupBy("role", "model", "digest").agg(one_answer(stored_answer(every)).alias("raw"))
        kept.select("digest", "raw.*", "role", "model").write.mode("errorifexists").partitionBy("role", "model").parquet(path)
        return AnswerStore(self.spark, path)


def sent_by(verifier: Verifier) -> tuple[str, Verifier]:
    """What stands before the claim, and the verifier that is sent both."""
    prefix = ""
    while isinstance(verifier, PrefixedVerifier):
        prefix, verifier = verifier.prefix + prefix, verifier.inner
    return prefix, verifier


def with_digests(claims: DataFrame, claim: Column, *verifiers: Verifier) -> DataFrame:
    """``claims`` with a column for the digest of what each verifier is sent."""
    return claims.withColumns({digest_column(p): digest_of(F.concat(F.lit(p), claim) if p else claim)
                               for p in (sent_by(v)[0] for v in verifiers)})


def digest_column(prefix: str) -> str:
    return f"__digest_{hashlib.md5(prefix.encode()).hexdigest()[:12]}"


class StoredAnswers(Verifier):
    """D4 by content: joins the stored answers on the digest of the text (a column of ``with_digests``, if there)."""

    def __init__(self, store: AnswerStore, role: str, verifier: Verifier):
        self.store, self.role, self.verifier = store, role, verifier
        self.prefix, self.asked = sent_by(verifier)
        self.name = f"stored_{verifier.name}"

    def answers(self, df, out_col, claim, gate=None):
        key = digest_column(self.prefix)
        rows = self.store.rows(self.role, self.asked.name).withColumnRenamed("digest", key)
        there = key in df.columns
        out = TableVerifier(rows, key).answers(df if there else with_digests(df, claim, self.verifier), out_col, claim, gate)
        return out if there else out.drop(key)


class StoredCascade:
    """D12 over an answer store; ``options`` are those of ``cascade``."""

    def __init__(self, claims: DataFrame, verifier_a: Verifier, verifier_b: Verifier, judge: Verifier, store: AnswerStore,
                 gamma: float | Column = 0.7, policy: str = "p1", **options):
        self.claims, self.store, self.gamma, self.policy, self.options = claims, store, gamma, policy, options
        self.verifiers = {"a": verifier_a, "b": verifier_b, "judge": judge}
        self.claim_col = options.get("claim_col", "claim")

    def where(self, condition: Column | str) -> "StoredCascade":
        """The cascade of the claims that meet ``condition``: the others are neither read nor asked about."""
        out = StoredCascade(self.claims.filter(condition), *self.verifiers.values(), self.store, self.gamma, self.policy,
                            **self.options)
        return out

    def plan(self, judge: Verifier, **options) -> DataFrame:
        """The cascade's rows and the digests of what is sent."""
        a, b = (self.store.verifier(r, self.verifiers[r]) for r in ("a", "b"))
        claims = with_digests(self.claims, F.col(self.claim_col), *self.verifiers.values())
        return cascade(claims, a, b, judge, self.gamma, self.policy, **self.options | options)

    def digests(self) -> list[str]:
        return [digest_column(sent_by(v)[0]) for v in self.verifiers.values()]

    def gated(self) -> DataFrame:
        """The gate over the answers of both verifiers; the truth is not part of it, so it is read only where selected."""
        for role in ("a", "b"):
            self.store.ask(self.claims, role, self.verifiers[role], self.claim_col)
        return self.plan(constant_verifier(None, name="unasked"), truth_col=None)

    def gate(self) -> DataFrame:
        """The claims with the verifiers' answers and the gate's decision; no judge is asked."""
        return self.gated().drop(*(c for c in DECISION_COLUMNS if c != "calls"), *self.digests())

    def results(self) -> DataFrame:
        """The whole result rows; the judge is asked about the escalated ones that are not answered yet."""
        judge = self.verifiers["judge"]
        escalated = self.gated().filter("escalated").select(F.col(digest_column(sent_by(judge)[0])).alias("digest"))
        self.store.ask(self.claims, "judge", judge, self.claim_col, escalated)
        return self.plan(self.store.verifier("judge", judge)).drop(*self.digests())
