"""Structured Streaming.

* J1 ``stream_cascade``: the batch cascade applied to a claim stream. It is
  all row-wise projections (plus the model UDFs), so it is stateless; each
  micro-batch is written with ``foreachBatch`` to ``sink/batch_id=<n>`` in
  overwrite mode, which makes a retried batch idempotent (exactly-once files).
* J2 ``stream_counters``: the reference's running counters (F1) and rates
  (F2) as a streaming aggregation; the state is the built-in aggregate state
  (one row per group), checkpointed by Spark. Readers see whole versions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictflow.operators import metrics as M
from verdictflow.operators.cascade import cascade
from verdictflow.streaming.snapshots import SnapshotSink


def dealt(stream: DataFrame) -> DataFrame:
    """A stream whose rows are dealt out over all cores in each trigger.

    Answering a row costs far more than moving it, and a trigger may hold a single file, which one task would read.
    """
    return stream.repartition(stream.sparkSession.sparkContext.defaultParallelism)


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a file stream (schema taken from the data once), :func:`dealt` out over all cores."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob that matches exactly this file: a file stream source needs a pattern or a directory
    return dealt(r.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]"))


def event_claims(events: DataFrame) -> DataFrame:
    """Claims from the ``events`` stream: key = event_id, text = event type + properties, no truth."""
    return events.select(F.col("event_id").alias("claim_id"),
                         F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("claim"),
                         F.col("event_type"), F.col("ts"))


def stream_cascade(claims: DataFrame, verifier_a, verifier_b, judge, sink: str, checkpoint: str,
                   gamma: float = 0.7, policy: str = "p1", available_now: bool = True,
                   written: Callable[[int], None] | None = None, **kw) -> StreamingQuery:
    """Label a claim stream; every micro-batch lands in ``sink/batch_id=<n>`` (idempotent).

    ``written(n)`` is called when batch n is written and before Spark notes that it is done: a crash in
    between makes Spark repeat the batch after a restart, which overwrites its own folder.
    """
    results = cascade(claims, verifier_a, verifier_b, judge, gamma, policy, **kw)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        if written is not None:
            written(batch_id)

    w = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def counter_frame(results: DataFrame, by=None, truth_col: str = "ground_truth") -> DataFrame:
    """F1 + F2 as one aggregation usable on a stream (the rates are a projection of the counters)."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    if truth_col not in results.columns:
        results = results.withColumn(truth_col, F.lit(None).cast("string"))
    c = results.groupBy(*keys).agg(*M.counter_columns(truth_col))
    return c.select(*keys, *[x for x in c.columns if x not in keys and x != "labelled"], *M.rates_from_counters())


def stream_counters(results: DataFrame, sink: str, checkpoint: str, by=None, available_now: bool = True,
                    output_mode: str = "complete", written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Running counters over a result stream, as versions of a :class:`SnapshotSink`.

    ``complete``: each version holds the totals of every group (right for a few groups). ``update``:
    each adds only the groups that changed - the form that scales to many groups.
    :func:`read_counters` returns the current row per group of either. ``written`` as in
    :func:`stream_cascade`.
    """
    if output_mode not in ("complete", "update"):
        raise ValueError("output_mode must be 'complete' or 'update'")
    agg = counter_frame(results, by)
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))

    def write(batch: DataFrame, batch_id: int) -> None:
        new = SnapshotSink(batch.sparkSession, sink).commit(batch_id, batch.write.parquet, output_mode == "update",
                                                            lambda rows: latest(rows, keys))
        if not new:  # a repeated batch changes nothing, but its state must still be computed
            batch.write.format("noop").mode("overwrite").save()
        if written is not None:
            written(batch_id)

    w = agg.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the row of its latest batch."""
    cols = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("__r")).select(*keys, "__r.*")


def read_counters(spark: SparkSession, sink: str, by=None) -> DataFrame:
    """The current counters of a sink: per group, the row of its latest batch in the version current now."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return latest(SnapshotSink(spark, sink).rows(), keys)
