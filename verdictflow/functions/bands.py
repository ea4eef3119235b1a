"""Severity bands of an escalation rate (C14).

Fixed values: the thresholds and labels of the reference's summary messages.
Each scheme is an ordered list of (comparison, threshold, label); the first
rule that holds wins, the last label applies otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictflow.functions.parsing import lit, sql_of

BAND_SCHEMES = {
    # macro-average over scenario groups
    "aggressive": ((">", 0.8, "maximum"), (">", 0.6, "high"), (">", 0.4, "moderate"), (None, None, "low")),
    # contested claims
    "contested": ((">=", 0.5, "excellent"), (">=", 0.3, "good"), (">", 0.0, "low"), (None, None, "none")),
    # edge cases
    "edge": ((">", 0.2, "good"), (">", 0.0, "low"), (None, None, "none")),
    # forced disagreement
    "forced": ((">=", 0.8, "success"), (None, None, "unexpected")),
    # verbose demo
    "demo": ((">=", 0.4, "excellent"), (">", 0.0, "good"), (None, None, "limited")),
}


def band_sql(rate: str, scheme: str) -> str:
    rules = BAND_SCHEMES[scheme]
    arms = " ".join(f"WHEN {rate} {op} {thr} THEN {lit(label)}" for op, thr, label in rules if op)
    return f"CASE {arms} ELSE {lit(rules[-1][2])} END"


def escalation_band(rate: str, scheme: str = "aggressive") -> Column:
    """C14: band label of an escalation-rate column (name or ``expr:`` SQL)."""
    return F.expr(band_sql(sql_of(rate), scheme))
