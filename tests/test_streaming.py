"""Versioned snapshots and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from verdictflow.plans import keys_data as K
from verdictflow.sources.derived import fixture_verifiers, text_key
from verdictflow.operators.cascade import cascade
from verdictflow.streaming import snapshots
from verdictflow.streaming.snapshots import SnapshotSink
from verdictflow.streaming.stream import event_claims, latest, read_counters, stream_cascade, stream_counters


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(spark, sink, batch, values, **how):
    df = spark.createDataFrame(values, "g string, n long")
    return sink.commit(batch, df.write.parquet, **how)


def test_versions(spark, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "s"), keep=1)
    with pytest.raises(FileNotFoundError):
        sink.rows()
    assert put(spark, sink, 0, [("a", 1)])
    bound = sink.rows()  # a reader of version 0
    assert put(spark, sink, 1, [("a", 2), ("b", 1)])
    assert rows(bound) == [("a", 1, 0)] and rows(sink.rows()) == [("a", 2, 1), ("b", 1, 1)]
    before = sorted(os.listdir(sink.path))
    assert not put(spark, sink, 1, [("a", 99)])  # a repeated batch changes nothing
    assert sorted(os.listdir(sink.path)) == before and rows(sink.rows()) == [("a", 2, 1), ("b", 1, 1)]
    put(spark, sink, 2, [("a", 3)])
    assert len([f for f in os.listdir(sink.path) if f.startswith("v-")]) == 2  # the current one and one to finish reading


def test_crash_before_the_pointer(spark, tmp_path, monkeypatch):
    """A version that nothing refers to is not seen, and is removed later."""
    sink = SnapshotSink(spark, str(tmp_path / "s"))
    put(spark, sink, 0, [("a", 1)])

    def lost(pointer):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(sink, "_replace_pointer", lost)
        with pytest.raises(RuntimeError):
            put(spark, sink, 1, [("a", 2)])
    assert rows(sink.rows()) == [("a", 1, 0)]
    assert put(spark, sink, 1, [("a", 2)]) and rows(sink.rows()) == [("a", 2, 1)]
    assert sum(f.startswith("v-1-") for f in os.listdir(sink.path)) == 1


def test_changed_groups_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "COMPACT_AFTER", 3)
    sink, want = SnapshotSink(spark, str(tmp_path / "s")), {}
    for n in range(8):
        change = {f"g{n % 3}": n, f"h{n}": n}
        want |= change
        put(spark, sink, n, list(change.items()), extend=True, merge=lambda r: latest(r, ["g"]))
        assert dict(rows(latest(sink.rows(), ["g"]))) == want
        assert len(sink.pointer()["folders"]) <= 3


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_reader_never_sees_a_mixture(spark, sf, tmp_path, mode):
    """What a reader sees between two triggers is the state after some whole batch; also after a repeated one."""
    events, crash = K._event_files(spark, sf, f"mixture-{mode}"), K._crash_once(1)
    a, b, j = fixture_verifiers()
    r = cascade(event_claims(events).withColumn("text_key", text_key("claim")), a, b, j, 0.7, truth_col=None)
    sink, seen, totals = str(tmp_path / "sink"), {}, {}

    def written(batch):
        counters = read_counters(spark, sink, "event_type")
        total = counters.agg(F.sum("total_evaluations")).first()[0]
        assert seen.setdefault(batch, total) == total  # the repeated batch shows the same
        totals[batch] = total
        crash(batch)
    K._until_done(lambda: stream_counters(r, sink, str(tmp_path / "ckpt"), "event_type", output_mode=mode, written=written))
    whole = spark.read.parquet(f"{sf}/events.parquet").count()
    assert list(totals) == [0, 1, 2, 3] and totals[3] == whole and sorted(totals.values()) == list(totals.values())


def test_restarted_cascade_equals_batch(spark, sf, tmp_path):
    events, crash = K._event_files(spark, sf, "restart"), K._crash_once(2)
    a, b, j = fixture_verifiers()
    claims = event_claims(events).withColumn("text_key", text_key("claim"))
    sink = str(tmp_path / "sink")
    K._until_done(lambda: stream_cascade(claims, a, b, j, sink, str(tmp_path / "ckpt"), truth_col=None, written=crash))
    table = event_claims(spark.read.parquet(f"{sf}/events.parquet")).withColumn("text_key", text_key("claim"))
    columns = ["claim_id", "final_verdict", "escalated", "reason", "min_confidence"]
    assert rows(spark.read.parquet(sink).select(*columns)) == rows(cascade(table, a, b, j, truth_col=None).select(*columns))
    assert len(os.listdir(sink)) == 4


def test_triggers_use_all_cores(spark, sf, tmp_path):
    """A trigger holds one file, whose rows are answered by as many tasks as there are cores."""
    tasks = []

    def write(batch, batch_id):
        tasks.append(batch.select(F.spark_partition_id().alias("p")).distinct().count())
    stream = K._event_files(spark, sf, "cores").writeStream.foreachBatch(write)
    stream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert tasks == [spark.sparkContext.defaultParallelism] * 4
