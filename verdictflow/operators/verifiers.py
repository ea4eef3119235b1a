"""Verifiers: where model answers come from.

A verifier adds one column, a *raw answer* struct
``STRUCT<verdict, confidence, reasoning, raw_output STRING, error STRING, elapsed_ms DOUBLE>``,
to a claims DataFrame. Parsing (``functions.parsing``) turns it into a result.

* :class:`RuleVerifier`  - a Column expression (mocks, canned answers, fixtures). JVM only.
* :class:`TableVerifier` - answers computed earlier, joined on the claim key.
* :class:`ModelVerifier` - any Python client, called through an Arrow-batched
  iterator ``pandas_udf``: a bounded window of calls in flight, retries, a deadline
  per claim, per-row error isolation, and rows whose input is NULL are never sent.

Every verifier accepts a ``gate`` Column: rows where it is false get a NULL
answer and cost nothing. That is how the judge is only asked about escalated rows.
"""

from __future__ import annotations

import concurrent.futures as cf
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_ANSWER_TYPE = T.StructType([
    T.StructField("verdict", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("raw_output", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.DoubleType()),
])
RAW_FIELDS = [f.name for f in RAW_ANSWER_TYPE.fields]


def _lit_or_col(v, typ: str) -> Column:
    if v is None:
        return F.lit(None).cast(typ)
    if isinstance(v, Column):
        return v.cast(typ)
    return F.lit(v).cast(typ)


def raw_answer(verdict=None, confidence=None, reasoning=None, raw_output=None, error=None, elapsed_ms=None) -> Column:
    """Build a raw answer struct from Columns or Python constants."""
    return F.struct(
        _lit_or_col(verdict, "string").alias("verdict"),
        _lit_or_col(confidence, "string").alias("confidence"),
        _lit_or_col(reasoning, "string").alias("reasoning"),
        _lit_or_col(raw_output, "string").alias("raw_output"),
        _lit_or_col(error, "string").alias("error"),
        _lit_or_col(elapsed_ms, "double").alias("elapsed_ms"),
    )


class Verifier:
    """Base class; ``answers`` adds ``out_col`` (raw answer struct) to ``df``."""

    name = "verifier"
    calls_model = False  # whether an answer costs a call

    def answers(self, df: DataFrame, out_col: str, claim: Column, gate: Column | None = None) -> DataFrame:
        raise NotImplementedError

    def with_prefix(self, prefix: str) -> "Verifier":
        """The verifier sees ``prefix + claim`` (prompt-prefix bias)."""
        return PrefixedVerifier(self, prefix)


class RuleVerifier(Verifier):
    """D3: answers from a Column expression ``rule(claim) -> raw answer struct``."""

    def __init__(self, rule: Callable[[Column], Column], name: str = "rule"):
        self.rule = rule
        self.name = name

    def answers(self, df, out_col, claim, gate=None):
        ans = self.rule(claim)
        if gate is not None:
            ans = F.when(gate, ans)
        return df.withColumn(out_col, ans)


def constant_verifier(verdict: str | None, confidence: str | None = None, reasoning: str | None = None,
                      name: str = "constant") -> RuleVerifier:
    """The mock of the reference tests: the same answer for every claim."""
    return RuleVerifier(lambda claim: raw_answer(verdict, confidence, reasoning), name=name)


def keyword_verifier(yes_pattern: str, confidence: str | None = None, name: str = "keyword") -> RuleVerifier:
    """A rule model: answers 'yes' when the whole claim text matches ``yes_pattern`` (Java regex)."""
    return RuleVerifier(
        lambda claim: raw_answer(F.when(claim.rlike(yes_pattern), F.lit("yes")).otherwise(F.lit("no")), confidence,
                                 F.lit("rule match")),
        name=name)


class PrefixedVerifier(Verifier):
    def __init__(self, inner: Verifier, prefix: str):
        self.inner = inner
        self.prefix = prefix
        self.name = f"{inner.name}+prefix"
        self.calls_model = inner.calls_model

    def answers(self, df, out_col, claim, gate=None):
        return self.inner.answers(df, out_col, F.concat(F.lit(self.prefix), claim), gate)


def stored_answer(outputs: DataFrame) -> Column:
    """The raw answer struct of a row of ``outputs``; fields that it lacks are NULL."""
    return raw_answer(**{c: F.col(c) if c in outputs.columns else None for c in RAW_FIELDS})


def one_answer(answer: Column) -> Column:
    """Aggregate: the answer kept of several stored ones.

    One without an error goes before one with an error; among these the smallest by verdict, then
    confidence, reasoning, raw output, error and time (NULL before any value). Ties are equal answers.
    """
    return F.min(F.when(answer.isNotNull(), F.struct(answer["error"].isNotNull().alias("failed"), answer.alias("kept"))))["kept"]


class TableVerifier(Verifier):
    """Precomputed answers ``(key, verdict, confidence, reasoning, raw_output, error)``.

    Lets users label once (offline or with a ModelVerifier + ``materialize``)
    and re-run the cascade, sweeps and reports without any model call. The
    answers are reduced to one per key (so a claim never gives several rows)
    and joined on it: both use the same partitioning, Spark picks broadcast or
    sort-merge from the measured size (AQE), and bucketing both sides on the key
    removes the shuffle. ``repeated='first'`` keeps the answer that
    :func:`one_answer` names, ``'fail'`` fails the job on a second answer. As keys
    are unique, Spark drops the join where no answer is selected.
    A claim without an answer gets a "missing answer" error row.
    """

    def __init__(self, outputs: DataFrame, key: str = "claim_id", name: str = "table", repeated: str = "first"):
        if repeated not in ("first", "fail"):
            raise ValueError("repeated must be 'first' or 'fail'")
        self.outputs = outputs
        self.key = key
        self.name = name
        self.repeated = repeated

    def answers(self, df, out_col, claim, gate=None):
        key, tmp = f"__{out_col}_key", f"__{out_col}_ans"
        given = self.outputs.select(F.col(self.key).alias(key), stored_answer(self.outputs).alias(tmp))
        right = given.groupBy(key).agg(one_answer(F.col(tmp)).alias(tmp), F.count(F.lit(1)).alias("__n"))
        if self.repeated == "fail":
            again = F.raise_error(F.concat(F.lit("several stored answers for "), F.col(key).cast("string")))
            right = right.filter(F.when(F.col("__n") > 1, again.cast("boolean")).otherwise(True))
        j = df.join(right.drop("__n"), df[self.key] == F.col(key), "left")
        ans = F.when(F.col(key).isNull(), raw_answer(error="missing answer")).otherwise(F.col(tmp))
        if gate is not None:
            ans = F.when(gate, ans)
        return j.withColumn(out_col, ans).drop(tmp, key)


class ColumnVerifier(Verifier):
    """Answers already on the row (a raw answer struct column), e.g. after :func:`join_answers`."""

    def __init__(self, col: str, name: str | None = None):
        self.col = col
        self.name = name or col

    def answers(self, df, out_col, claim, gate=None):
        ans = F.col(self.col)
        if gate is not None:
            ans = F.when(gate, ans)
        return df.withColumn(out_col, ans)


def join_answers(claims: DataFrame, outputs: DataFrame, key: str = "claim_id", role_col: str = "role",
                 roles: tuple[str, ...] = ("a", "b", "judge")) -> tuple[DataFrame, tuple[ColumnVerifier, ...]]:
    """D4 at scale: attach every role's precomputed answer with ONE join.

    ``outputs`` is long (``key, role, verdict, confidence, reasoning, raw_output, error``).
    It is grouped by key (one shuffle, map-side partial aggregation) and joined
    to the claims on the same key, so the join reuses that partitioning instead
    of three separate joins each shuffling the claims. Returns the widened claims
    and one :class:`ColumnVerifier` per role (a missing answer becomes an error row; of
    several, :func:`one_answer` names the one kept).
    """
    given = outputs.select(F.col(key).alias(f"__{key}"), F.col(role_col).alias("__role"), stored_answer(outputs).alias("__ans"))
    wide = given.groupBy(f"__{key}").agg(
        *[one_answer(F.when(F.col("__role") == r, F.col("__ans"))).alias(f"__ans_{r}") for r in roles])
    j = claims.join(wide, claims[key] == wide[f"__{key}"], "left").drop(f"__{key}")
    missing = raw_answer(error="missing answer")
    j = j.withColumns({f"__ans_{r}": F.coalesce(F.col(f"__ans_{r}"), missing) for r in roles})
    return j, tuple(ColumnVerifier(f"__ans_{r}", name=f"precomputed_{r}") for r in roles)


# --------------------------------------------------------------------------- D1 / D14
ClientFn = Callable[[pd.Series], pd.DataFrame]


def _answers_frame(out: pd.DataFrame, n: int) -> pd.DataFrame:
    out = out.reset_index(drop=True)
    if len(out) != n:
        raise ValueError(f"model client returned {len(out)} answers for {n} claims")
    res = pd.DataFrame(index=range(n))
    for c in RAW_FIELDS[:4]:
        if c in out.columns:
            s = out[c].astype(object)
            res[c] = s.where(s.isna(), s.astype(str))
        else:
            res[c] = None
    return res


@dataclass
class Call:
    """One call: which claims, since when they wait for an answer, how often it was tried."""

    rows: list[int]
    first: float | None = None
    tries: int = 0
    started: float = 0.0
    client: ClientFn | None = None


class CallWindow:
    """The model calls of one task: at most ``in_flight`` at once, every claim done by its deadline.

    A call that fails is tried again ``retries`` times; then, and when a call of several claims is not
    back after half of the limit, its claims are asked one by one. A claim's deadline counts from its
    first call (a call of its own has at least half of the limit), so that a client that hangs on one
    claim costs that claim one limit and its neighbours half of one. After ``give_up_after`` failed
    claims in a row the following ones get an error unasked, but for one probe after each
    ``give_up_after`` of them; once a probe succeeds, all are asked again.
    """

    def __init__(self, factory: Callable[[], ClientFn], in_flight: int, retries: int, timeout_s: float | None,
                 give_up_after: int | None):
        self.factory, self.in_flight, self.retries, self.limit = factory, in_flight, retries, timeout_s
        self.give_up_after = give_up_after
        self.idle: list[ClientFn] = []  # a client serves one call at a time; one that hangs is left behind
        self.failures = self.skipped = 0

    def start(self, call: Call, claims: pd.Series) -> cf.Future:
        call.client = self.idle.pop() if self.idle else self.factory()
        call.started = time.monotonic()
        call.first = call.first or call.started
        done: cf.Future = cf.Future()
        sent = claims.iloc[call.rows].reset_index(drop=True)

        def run() -> None:
            try:
                done.set_result(_answers_frame(call.client(sent), len(sent)))
            except BaseException as e:  # noqa: BLE001 - handed to the caller
                done.set_exception(e)

        threading.Thread(target=run, daemon=True).start()  # a thread that hangs must not hold up the worker's end
        return done

    def due(self, call: Call) -> float:
        if self.limit is None:
            return float("inf")
        if len(call.rows) > 1:
            return call.started + self.limit / 2
        return max(call.first + self.limit, call.started + self.limit / 2)

    def answers(self, claims: pd.Series, batch_size: int) -> list[tuple]:
        """(verdict, confidence, reasoning, raw_output, error, elapsed_ms) of each claim."""
        out: list[tuple] = [()] * len(claims)
        waiting = deque(Call(list(range(i, min(i + batch_size, len(claims))))) for i in range(0, len(claims), batch_size))
        running: dict[cf.Future, Call] = {}

        def failed(call: Call, error: str) -> None:
            self.failures += 1
            for r in call.rows:
                out[r] = (None,) * 4 + (error, (time.monotonic() - call.started) * 1000.0)

        def one_by_one(call: Call) -> None:
            waiting.extendleft(Call([r], call.first, self.retries) for r in reversed(call.rows))

        while waiting or running:
            while waiting and len(running) < self.in_flight:
                call = waiting.popleft()
                if self.give_up_after and self.failures >= self.give_up_after:
                    if running:  # wait for what is under way before another probe
                        waiting.appendleft(call)
                        break
                    probe = self.skipped >= self.give_up_after
                    rest = call.rows[1:] if probe else call.rows
                    for r in rest:
                        out[r] = (None,) * 4 + (f"not asked: {self.failures} claims failed in a row", None)
                    self.skipped = len(rest) + (0 if probe else self.skipped)
                    if not probe:
                        continue
                    call.rows = call.rows[:1]
                running[self.start(call, claims)] = call
            if not running:
                continue
            wait = min(map(self.due, running.values())) - time.monotonic()
            cf.wait(running, None if wait == float("inf") else max(wait, 0), cf.FIRST_COMPLETED)
            now = time.monotonic()
            for done, call in list(running.items()):
                if done.done():
                    del running[done]
                    self.idle.append(call.client)
                    error = done.exception()
                    if error is None:
                        self.failures, frame = 0, done.result()
                        each = (now - call.started) * 1000.0 / len(call.rows)
                        for r, values in zip(call.rows, frame.itertuples(index=False), strict=True):
                            out[r] = (*values, None, each)
                    elif call.tries < self.retries:
                        call.tries += 1
                        waiting.appendleft(call)
                    elif len(call.rows) > 1:
                        one_by_one(call)
                    else:
                        failed(call, f"{type(error).__name__}: {error}")
                elif now >= self.due(call):
                    del running[done]
                    if len(call.rows) > 1:
                        one_by_one(call)
                    else:
                        failed(call, "timeout")
        return out


class ModelVerifier(Verifier):
    """A Python model client run as an Arrow-batched iterator ``pandas_udf``.

    ``client_factory()`` makes a client; a task makes one per call that it has in flight (at most
    ``in_flight``), so a client need not be thread-safe. It maps a ``pd.Series`` of claims to a
    ``pd.DataFrame`` with any of ``verdict, confidence, reasoning, raw_output``. Retries, the limit of
    ``timeout_s`` per claim and the breaker are those of :class:`CallWindow`; a claim that fails or
    takes too long becomes an answer with ``error`` set (never a job failure).
    """

    calls_model = True

    def __init__(self, client_factory: Callable[[], ClientFn], name: str = "model", batch_size: int = 64,
                 retries: int = 2, timeout_s: float | None = 60.0, in_flight: int = 8, give_up_after: int | None = 32):
        self.client_factory = client_factory
        self.name = name
        self.batch_size = batch_size
        self.retries = retries
        self.timeout_s = timeout_s
        self.in_flight = in_flight
        self.give_up_after = give_up_after
        self._udf = self._build_udf()

    def _build_udf(self):
        settings = (self.client_factory, self.in_flight, self.retries, self.timeout_s, self.give_up_after)
        batch_size = self.batch_size

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            window = CallWindow(*settings)
            for claims in batches:
                given = claims.notna().to_numpy()
                found = iter(window.answers(claims[given].reset_index(drop=True), batch_size))
                rows = [next(found) if g else (None,) * len(RAW_FIELDS) for g in given.tolist()]
                out = pd.DataFrame(rows, columns=RAW_FIELDS, dtype=object)
                out["elapsed_ms"] = out["elapsed_ms"].astype("float64")
                yield out

        return F.pandas_udf(run, RAW_ANSWER_TYPE).asNondeterministic()

    def answers(self, df, out_col, claim, gate=None):
        arg = claim if gate is None else F.when(gate, claim)
        # the UDF returns a struct for every row; NULL inputs were not sent -> NULL answer
        return df.withColumn(out_col, F.when(arg.isNotNull(), self._udf(arg)))
