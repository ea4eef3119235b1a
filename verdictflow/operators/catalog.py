"""Model catalogue checks.

The catalogue is a user-supplied DataFrame ``model STRING, pos INT`` (``pos`` =
listing order). There is no model server here: whatever lists the models
(an HTTP call, a config file) produces that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_models(required: DataFrame, available: DataFrame, col: str = "model") -> DataFrame:
    """E5: required models absent from the catalogue (left anti-join)."""
    return required.select(col).distinct().join(available.select(col), col, "left_anti")


def all_present(required: DataFrame, available: DataFrame, col: str = "model") -> tuple[bool, list[str]]:
    """E5 as the reference returns it: (all present, missing names) - the missing list is small."""
    missing = [r[0] for r in missing_models(required, available, col).orderBy(col).collect()]
    return not missing, missing


def pick_model(available: DataFrame, preferred: str, fragment: str, fallback: str = "first",
               col: str = "model", pos: str = "pos") -> DataFrame:
    """The exact ``preferred`` name if listed, else the first name containing ``fragment``,
    else the first (or last) model in listing order. One aggregation, one row out."""
    exact = F.col(col) == preferred
    part = F.col(col).contains(fragment)
    fb = F.col(pos) if fallback == "first" else -F.col(pos)
    rank = F.struct(F.when(exact, 0).when(part, 1).otherwise(2).alias("tier"),
                    F.when(exact | part, F.col(pos)).otherwise(fb).alias("order"))
    return available.agg(F.min_by(F.col(col), rank).alias(col))
