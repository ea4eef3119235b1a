"""Properties of the P1 parser on random answers (hypothesis): what no wording may break."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from verdictflow.functions import parsing as P
from verdictflow.operators.verifiers import RAW_ANSWER_TYPE

PIECES = ["yes", "No", "TRUE", "false", "invalid", "untrue", "maybe", "I am", "sure", "confident", "85%", "150%", "0.5%",
          "1.2.3%", "%", "\n", "  ", "might be", "not", "uncertain", "likely", "30", "accurate", "source", ""]
text = st.lists(st.sampled_from(PIECES), max_size=8).map(" ".join)


def parsed(spark, answers):
    """(verdict, confidence, reasoning, raw_output) -> (verdict, prediction, confidence)."""
    rows = [(i, (v, c, r, o, None, None)) for i, (v, c, r, o) in enumerate(answers)]
    df = spark.createDataFrame(rows, f"claim_id long, raw {RAW_ANSWER_TYPE.simpleString()}")
    got = {x["claim_id"]: x["r"] for x in P.parse_role(df, "raw", "r").collect()}
    return [(got[i]["verdict"], got[i]["prediction"], got[i]["confidence"]) for i in range(len(rows))]


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(text, text), min_size=150, max_size=150))
def test_parser_properties(spark, cases):
    n = len(cases)
    plain = [(v, None, r, "") for v, r in cases]
    shouted = [(f"  {v.upper()}\n", None, r.upper(), "") for v, r in cases]
    stated = [(v, "1.7", r, "") for v, r in cases]
    below = [(v, "-3", r, "") for v, r in cases]
    odd = [(v, "no number", r, "") for v, r in cases]
    first = [(v, None, "80% confident " + r, "") for v, r in cases]
    got = parsed(spark, plain + shouted + stated + below + odd + first)
    base = got[:n]
    assert all(v in ("yes", "no") and p == (v == "yes") and 0.0 <= c <= 1.0 for v, p, c in got)
    assert [x[0] for x in got[n:2 * n]] == [x[0] for x in base]  # case and outer blanks do not matter
    assert all(c == 1.0 for _, _, c in got[2 * n:3 * n])  # a stated number wins and is clamped
    assert all(c == 0.0 for _, _, c in got[3 * n:4 * n])
    assert got[4 * n:5 * n] == base  # an unreadable one is as none
    assert all(c == 0.8 for _, _, c in got[5 * n:])  # the first readable percentage wins


def test_printed_answer_shows_the_normalised_verdict(spark):
    """Words of the model's own verdict say nothing about its confidence once it is reduced to yes or no."""
    got = parsed(spark, [("maybe", None, "", None), ("definitely yes", None, "", None), ("yes", None, "", None),
                         ("no", None, "definitely", None), ("yes", None, "", "definitely")])
    default = got[2][2]
    assert [x[2] for x in got[:3]] == [default] * 3 and got[3][2] == got[4][2] > default
    # a pattern does not reach over the line of a printed field
    assert parsed(spark, [("yes", "x%", "sure", None)])[0][2] == parsed(spark, [("yes", None, "sure", None)])[0][2]
