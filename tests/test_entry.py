"""The driver contract: entry(), queries() and oracle_sql() on sf0.001 against DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, canon

FAST_KEYS = ["cascade", "eval_accuracy", "gamma_sweep", "confidence_full", "parse_strict", "balanced_sample",
             "paired_ttest", "compare_configs", "sweep_report", "jsonl_records", "fallback_rows"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "overall_accuracy" in df.columns


def test_keys_have_oracles():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    rows_only = {k for k in set(q) - set(o) if k != "pipeline" and not re.match(r"op\d+_", k)}  # those have tests of their own
    assert rows_only == set()


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_matches(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[key](spark, sf)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("key", ["cascade_all", "evaluation_metrics_all", "gamma_sweep_all", "jsonl_records_full",
                                 "metrics_json_full", "quick_eval_rows"])
def test_all_documents_match(spark, sf, key):
    test_oracle_matches(spark, sf, key)
