"""Golden tables for the parsers (FIXTURES.md F-3, F-4) and the P2/P3 parsers."""

import pytest
from pyspark.sql import functions as F

from verdictflow.functions import parsing as P
from verdictflow.operators.verifiers import RAW_ANSWER_TYPE

# (raw verdict, expected) - F-3
GOLDEN_VERDICTS = [
    ("yes", "yes"), ("No.", "no"), ("Yes, this is correct", "yes"), ("No, this is false", "no"),
    ("True statement", "yes"), ("Invalid claim", "no"), ("ambiguous response", "no"), ("incorrect", "no"),
    ("invalid", "no"), ("valid", "yes"), ("untrue", "yes"), ("not true", "no"), ("unknown", "no"),
    ("yes, no doubt", "no"), ("I cannot say", "no"), ("maybe", "no"), ("", "no"), ("  TRUE\n", "yes"),
    ("yes yes no", "yes"), ("false. Not correct", "no"),
]
# ambiguous verdict with reasoning
GOLDEN_REASONING = [("This is accurate", "yes"), ("this is incorrect", "yes"), ("inaccurate", "yes"),
                    ("wrong", "no"), ("plain text", "no")]
# (reasoning text, expected confidence) - F-4 (no structured value, raw_output empty)
GOLDEN_CONF = [
    ("I am 95% confident this is correct", 0.95), ("I am definitely sure this is accurate", 0.85),
    ("I might be wrong but this seems false", 0.4), ("I am uncertain", 0.9), ("not sure at all", 0.7),
    ("this is unlikely", 0.7), ("we measured it", 0.7), ("1% confident", 1.0), ("0.5% sure", 0.5),
    ("150% certain", 1.0), ("1.2.3% confident", 0.75), ("1.2.3% confident, 80% sure", 0.8), ("nothing here", 0.6),
    ("doubtful", 0.3), ("could be wrong", 0.3), ("think it may hold", 0.6), ("I believe so", 0.65),
    ("confidence is\n80%", 0.6), ("perhaps", 0.4), ("extremely confident", 0.95), ("fairly confident", 0.75),
    ("probability of about 35%", 0.35),
]


def _parse(spark, rows, policy="p1"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)],
                               f"claim_id long, raw {RAW_ANSWER_TYPE.simpleString()}")
    return {r["claim_id"]: r["r"] for r in P.parse_role(df, "raw", "r", policy).collect()}


def test_golden_verdicts(spark):
    rows = [(v, None, "", "", None, None) for v, _ in GOLDEN_VERDICTS]
    got = _parse(spark, rows)
    for i, (v, want) in enumerate(GOLDEN_VERDICTS):
        assert got[i]["verdict"] == want, v
        assert got[i]["prediction"] == (1 if want == "yes" else 0)


def test_golden_reasoning(spark):
    rows = [("maybe", None, r, "", None, None) for r, _ in GOLDEN_REASONING]
    got = _parse(spark, rows)
    for i, (r, want) in enumerate(GOLDEN_REASONING):
        assert got[i]["verdict"] == want, r


def test_golden_confidence(spark):
    rows = [("yes", None, t, "", None, None) for t, _ in GOLDEN_CONF]
    got = _parse(spark, rows)
    for i, (t, want) in enumerate(GOLDEN_CONF):
        assert got[i]["confidence"] == pytest.approx(want), t


@pytest.mark.parametrize("conf,raw,want", [
    ("0.9", None, 0.9), ("1.7", None, 1.0), ("-2", None, 0.0), ("90%", "confidence='90%'", 0.9),
    ("high", "confidence='high'", 0.6), ("nan", None, 0.6), (" 0.25 ", None, 0.25), ("1e-1", None, 0.1),
])
def test_structured_confidence(spark, conf, raw, want):
    got = _parse(spark, [("yes", conf, "", raw, None, None)])
    assert got[0]["confidence"] == pytest.approx(want)


def test_failed_outputs(spark):
    got = _parse(spark, [("yes", "0.9", "sure", None, "boom", None), (None, None, None, None, None, None)])
    assert got[0]["verdict"] == "no" and got[0]["reasoning"] == "Error: boom" and got[0]["error"] == "boom"
    assert got[1]["verdict"] == "no" and got[1]["reasoning"] == "Model output error"
    assert got[0]["confidence"] == pytest.approx(0.6) and got[1]["confidence"] == pytest.approx(0.6)


def test_p2_parser(spark):
    got = _parse(spark, [("yes", None, "", None, None, None), ("No", None, "", None, None, None),
                         ("maybe", None, "", None, None, None), ("yes", None, "", None, "x", None)], "p2")
    assert (got[0]["prediction"], got[0]["confidence"]) == (1, 0.8)
    assert (got[1]["prediction"], got[1]["confidence"]) == (0, 0.8)
    assert (got[2]["prediction"], got[2]["confidence"]) == (0, 0.5)
    assert (got[3]["prediction"], got[3]["confidence"], got[3]["reasoning"]) == (0, 0.5, "Parse error")


def test_p3_coin_flip_is_reproducible(spark):
    rows = [("unclear", None, "", None, None, None)] * 50
    a = _parse(spark, rows, "p3")
    b = _parse(spark, rows, "p3")
    assert a == b
    assert {r["verdict"] for r in a.values()} == {"yes", "no"}


def test_biased_parser(spark):
    df = spark.createDataFrame([(0, ("unclear", None, None, None, None, None)), (1, ("no", None, None, None, None, None))],
                               f"claim_id long, raw {RAW_ANSWER_TYPE.simpleString()}")
    got = [r[0] for r in df.orderBy("claim_id").select(P.parse_biased("raw", "yes")["verdict"]).collect()]
    assert got == ["yes", "no"]


def test_java_regex_keeps_python_semantics(spark):
    df = spark.createDataFrame([("confident\r 70%",), ("confident\n 70%",)], "t string")
    got = [r[0] for r in df.select(P.confidence_percent("t")).collect()]
    assert got == [pytest.approx(0.7), None]  # Python's '.' crosses \r but not \n


def test_lexicon_order_quirks(spark):
    df = spark.createDataFrame([("uncertain",), ("not sure",), ("might be wrong",)], "t string")
    got = [r[0] for r in df.select(P.confidence_lexicon("t")).collect()]
    assert got == [0.9, 0.7, 0.4]  # first phrase in declared order wins (quirk Q2)


def test_bands(spark):
    from verdictflow.functions.bands import escalation_band
    df = spark.createDataFrame([(0.9,), (0.5,), (0.0,)], "r double")
    got = [r[0] for r in df.select(escalation_band("r", "aggressive")).collect()]
    assert got == ["maximum", "moderate", "low"]
    got = [r[0] for r in df.select(escalation_band("r", "contested")).collect()]
    assert got == ["excellent", "excellent", "none"]


def test_no_python_udf_in_parser_plan(spark):
    df = spark.createDataFrame([(1, ("yes", "0.9", "sure", None, None, None))],
                               f"claim_id long, raw {RAW_ANSWER_TYPE.simpleString()}")
    plan = P.parse_role(df, "raw", "r")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert F is not None


def test_percent_patterns_on_random_texts(spark):
    """The first match of every pattern, as Python's ``re`` finds it, also across lines and with numbers in a row."""
    import random
    import re

    rng = random.Random(11)
    bits = ["confident", "confidence", "certain", "sure", "probability", "80%", " 5.5 %", "3.4.5%", ".%", "9", "%", "\n", "\r", " ", " ",
            "\xa0", "x", "0.7%", "12%confident", "unsure", "70% ", "\u0085", "a 1 b"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]

    def expected(text):
        for p in P.PERCENT_PATTERNS:
            if (m := re.search(p, text)) and re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", m[1]):
                v = float(m[1])
                return min(v / 100 if v > 1 else v, 1.0)
        return None
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.v for r in df.select("i", P.confidence_percent("t").alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [expected(t) for t in texts]
    assert sum(v is not None for v in got.values()) > 500


def test_percent_patterns_take_linear_time(spark):
    import time

    hard = ["% " + "confident sure certain confidence probability " * 40_000, "1" * 1_000_000 + " %", "%" + " " * 1_000_000,
            ("sure " * 500 + "\n") * 400 + "% "]
    df = spark.createDataFrame([(t,) for t in hard], "t string")
    df.limit(0).select(P.confidence_percent("t")).collect()
    start = time.monotonic()
    assert [r[0] for r in df.select(P.confidence_percent("t")).collect()] == [None] * 4
    assert time.monotonic() - start < 20
