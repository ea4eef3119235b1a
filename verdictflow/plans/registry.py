"""Registered queries: one Spark callable per operator key, with its DuckDB oracle.

Every query reads the driver tables (``documents``, ``labels``, ``events``,
``conversations``, ``benchmark``) through the library, over whole tables and
whole texts. Double columns are rounded to 9 decimals on both sides so that
the value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.plans import oracle as O

ROUND = 9


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | Callable[[], str] | None = None, doubles=()):
    def deco(fn):
        s = sql() if callable(sql) else sql
        REGISTRY[name] = Entry(name, fn, s, tuple(doubles))
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), ROUND).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded_sql(sql: str, doubles) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {ROUND}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


def _load():
    """Import the key modules (each registers its queries)."""
    from verdictflow.plans import keys, keys_data, keys_parsing  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda e: (lambda spark, sf_dir: rounded(e.fn(spark, sf_dir))))(e) for k, e in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {k: rounded_sql(e.sql, e.doubles) for k, e in REGISTRY.items() if e.sql is not None}


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


__all__ = ["register", "REGISTRY", "spark_queries", "oracle_queries", "O", "with_ctes"]
