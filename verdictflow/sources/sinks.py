"""Sinks (A9-A14): datasets, results, sweeps, mixed-record JSONL, run logs.

Results are written as distributed files (JSON Lines keep the nested
answer structs as real JSON objects; Parquet keeps the types). The reference's
single-object JSON layouts are offered for small outputs only, behind an
explicit row bound, because one JSON object cannot be written in parallel.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.sources.datasets import check_format

def save_dataset(df: DataFrame, path: str, metadata: dict | None = None, max_rows: int | None = None,
                 mode: str = "overwrite") -> None:
    """``.json`` = one object ``{claims, labels, size, metadata}`` in ``claim_id`` order
    (one row in one task: the caller must state ``max_rows``); ``.csv`` = ``claim,label`` with header; ``.jsonl`` / ``.parquet`` scale."""
    s = check_format(path)
    cols = df.select("claim_id", "claim", "label")
    if s == ".json":
        if max_rows is None:
            raise ValueError("one JSON object is written by one task: state max_rows, or write .jsonl or .parquet")
        n = cols.count()
        if n > max_rows:
            raise ValueError(f"{n} rows is too many for one JSON object; write .jsonl or .parquet")
        one = cols.agg(F.sort_array(F.collect_list(F.struct("claim_id", "claim", "label"))).alias("r"))
        one = one.select(F.col("r.claim").alias("claims"), F.col("r.label").alias("labels"),
                         F.size("r").alias("size"), F.lit(json.dumps(metadata or {})).alias("metadata"))
        one.coalesce(1).write.mode(mode).json(path)
    elif s == ".csv":
        cols.select("claim", "label").write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif s == ".jsonl":
        cols.write.mode(mode).json(path)
    else:
        cols.write.mode(mode).parquet(path)


def save_results(results: DataFrame, path: str, gamma: float | None = None, history: DataFrame | None = None,
                 include_metadata: bool = True, mode: str = "overwrite") -> None:
    """A10: ``path/results`` (JSON Lines, nested structs kept) + ``path/metadata`` (one row)."""
    results.write.mode(mode).json(f"{path.rstrip('/')}/results")
    if include_metadata:
        spark = results.sparkSession
        meta = spark.createDataFrame([(time.time(), gamma)], "timestamp double, system_config double")
        meta.coalesce(1).write.mode(mode).json(f"{path.rstrip('/')}/metadata")
        if history is not None:
            history.coalesce(1).write.mode(mode).json(f"{path.rstrip('/')}/evaluation_history")


def run_manifest(results: DataFrame, base: str, config: dict, args: dict | None = None,
                 run_id: str | None = None, started: float | None = None) -> str:
    """Results under ``base/results/run_id=<id>/`` and one row in ``base/runs``; returns the id."""
    run_id = run_id or f"run_{int(time.time())}_{uuid.uuid4().hex[:6]}"
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id") \
        .parquet(f"{base.rstrip('/')}/results")
    now = time.time()
    spark = results.sparkSession
    row = spark.createDataFrame([(run_id, now, (now - started) if started else None, json.dumps(config),
                                  json.dumps(args or {}))],
                                "run_id string, timestamp double, duration double, config string, args string")
    row.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/runs")
    return run_id


def save_sweep(sweep: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per gamma, so a single file: CSV with header, or JSON records."""
    s = check_format(path)
    out = sweep.orderBy("pos").coalesce(1).write.mode(mode)
    if s == ".csv":
        out.option("header", True).csv(path)
    elif s in (".json", ".jsonl"):
        out.json(path)
    else:
        out.parquet(path)


def typed_records(metadata: DataFrame | None, *typed: tuple[str, DataFrame]) -> DataFrame:
    """One frame of mixed record types (``type`` column, missing columns NULL)."""
    frames = [df.withColumn("type", F.lit(t)) for t, df in typed]
    if metadata is not None:
        frames.insert(0, metadata.withColumn("type", F.lit("metadata")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines (``ignoreNullFields`` keeps each record to its own fields)."""
    df.write.mode(mode).json(path)


def evaluation_records(results: DataFrame) -> DataFrame:
    """One record per result, labelled or contested by its truth; a row that failed as a whole
    (D13) becomes an error record. Fields that a record does not have are NULL."""
    from verdictflow.operators.cascade import preview
    labelled = "(ground_truth IS NOT NULL AND ground_truth <> '')"
    ok = "(reason <> 'error')"

    def only(cond, value):
        return F.when(F.expr(cond), F.col(value) if isinstance(value, str) else value)

    return results.select(
        F.expr(f"CASE WHEN {labelled} THEN 'labeled' ELSE 'contested_factual' END").alias("type"), "claim_id", "claim",
        only(labelled, "ground_truth").alias("expected"), only(f"{labelled} AND {ok}", "final_verdict").alias("predicted"),
        F.expr(f"CASE WHEN {labelled} THEN {ok} AND correct END").alias("correct"),
        F.expr(f"{ok} AND escalated").alias("escalated"), only(ok, F.col("elapsed_ms") / 1000).alias("time"),
        only(ok, "a.confidence").alias("a_confidence"), only(ok, "b.confidence").alias("b_confidence"),
        only(ok, "judge.confidence").alias("ref_confidence"),
        only(f"NOT {labelled} AND {ok}", "a.prediction").alias("verifier_a"),
        only(f"NOT {labelled} AND {ok}", "b.prediction").alias("verifier_b"),
        only(f"NOT {labelled} AND {ok}", "final_prediction").alias("final"),
        only(f"NOT {labelled} AND {ok}", preview(F.col("a.reasoning"))).alias("a_reasoning"),
        only(f"NOT {labelled} AND {ok}", preview(F.col("b.reasoning"))).alias("b_reasoning"),
        only(f"NOT {ok}", "a.error").alias("error"))


def write_evaluation(results: DataFrame, path: str, config, seed: int = 0) -> DataFrame:
    """Metadata, one record per result and a summary as JSON Lines; read back with their schema.

    The results are computed once: the summary comes from the written records.
    """
    spark = results.sparkSession
    roles = (("verifier_a", config.verifier_a), ("verifier_b", config.verifier_b), ("referee", config.judge))
    meta = spark.range(1).select(
        F.lit(int(time.time())).cast("bigint").alias("timestamp"), F.lit(seed).alias("seed"),
        F.lit(float(config.gamma)).alias("gamma"), F.struct(*[F.lit(s.model).alias(n) for n, s in roles]).alias("models"),
        F.struct(*[F.lit(float(s.temperature)).alias(n) for n, s in roles]).alias("temperatures"))
    records = evaluation_records(results)
    write_jsonl(typed_records(meta).unionByName(records, allowMissingColumns=True), path)
    back = spark.read.schema(records.schema).json(path).filter("type <> 'metadata'")
    summary = back.agg(
        F.expr("avg(CASE WHEN type = 'labeled' THEN CAST(correct AS INT) END)").alias("labeled_accuracy"),
        F.expr("avg(CASE WHEN type = 'contested_factual' THEN CAST(escalated AS INT) END)")
        .alias("contested_factual_escalation_rate"),
        F.expr("sum(CASE WHEN escalated OR error IS NOT NULL THEN 3 ELSE 2 END)").alias("total_model_calls"))
    summary = typed_records(None, ("summary", summary))
    write_jsonl(summary, path, "append")
    empty = typed_records(meta).limit(0).unionByName(records.limit(0), allowMissingColumns=True)
    return spark.read.schema(empty.unionByName(summary.limit(0), allowMissingColumns=True).schema).json(path)


def append_run_log(spark: SparkSession, path: str, dataset_name: str, dataset_size: int, seconds: float,
                   metrics: DataFrame) -> DataFrame:
    """Append ``dataset_name, dataset_size, evaluation_time, timestamp`` + metric columns to a log table."""
    row = metrics.select(F.lit(dataset_name).alias("dataset_name"), F.lit(int(dataset_size)).alias("dataset_size"),
                         F.lit(float(seconds)).alias("evaluation_time"), F.lit(time.time()).alias("timestamp"),
                         F.to_json(F.struct(*metrics.columns)).alias("final_metrics"))
    row.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)
