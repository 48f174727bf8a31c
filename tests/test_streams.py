"""Streams on small input: rows are conserved, alerts hold and clear, series come back; and keys that hold a share."""

from __future__ import annotations

import glob
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumispark.operators import candidates as C
from lumispark.operators import heavy, operations
from lumispark.plans import derive, state_twins
from lumispark.schemas import CANDIDATE, ENVELOPE
from lumispark.sources.messages import encode
from lumispark.streaming import pipelines, state


def candidate_files(spark, path, n=20):
    rows = spark.range(n).select(
        F.format_string("e%d", "id").alias("event_id"), F.lit(1).alias("event_type"), F.format_string("OBJ-%06d", "id").alias("object_id"), F.lit(1).cast("long").alias("candidate_revision"),
        F.lit(1).cast("long").alias("light_curve_revision"), F.lit(9).cast("long").alias("eligible_epoch_count"), F.timestamp_seconds(F.lit(derive.BEGIN)).alias("occurred_at"), F.lit("p").alias("producer"),
        F.when(F.col("id") % 4 > 0, "v1").otherwise("").alias("upstream_pipeline_version"), F.col("id").alias("offset"),
    )
    for f in CANDIDATE:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = rows.select(F.col("object_id").cast("binary").alias("key"), encode(F.struct(*(f.name for f in CANDIDATE))).alias("value"), F.lit("candidates").alias("topic"), F.lit(0).alias("partition"), "offset", F.col("occurred_at").alias("timestamp"))
    rows.withColumn("headers", F.lit(None).cast(ENVELOPE["headers"].dataType)).write.parquet(f"{path}/in")
    return spark.readStream.schema(ENVELOPE).parquet(f"{path}/in")


@pytest.mark.parametrize("fault", ["lost", "twice"])
def test_a_stream_that_loses_or_doubles_a_row_stops_and_goes_on_when_mended(spark, tmp_path, monkeypatch, fault):
    run = lambda: pipelines.candidate_stream(candidates, "candidates", "b", "commands", "dlq", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    candidates = candidate_files(spark, f"{tmp_path}")
    commands = C.commands
    with monkeypatch.context() as m:
        m.setattr(C, "commands", lambda *a: commands(*a).where("object_id <> 'OBJ-000007'") if fault == "lost" else commands(*a).union(commands(*a).where("object_id = 'OBJ-000007'")))
        with pytest.raises(StreamingQueryException, match="RowsLostError"):
            run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out/commands").count() == 15 and spark.read.parquet(f"{tmp_path}/out/dead_letters").count() == 5


def feed(spark, path, rows, schema, make):
    """What a stream gives out over batches of rows, a file each; the stream is begun again for the second half."""
    session = state.stateful_session(spark)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k in (len(rows) // 2, len(rows) - 1):
            stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
            make(stream.withColumn("ts", F.timestamp_seconds("at"))).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").where("pod is not null").collect())


END = [(None, 10_000_000, None, 0.0)]


def test_alert_holds_for_two_windows_and_clears_also_when_a_series_falls_silent(spark, tmp_path):
    bad = lambda pod, minute, share: [(pod, minute * 60 + i, "5xx" if i < 60 * share else "2xx", 1.0) for i in range(60)]
    # a: fires in minutes 1-3, not in 4; b: in 1 and 2, then nothing; c: in 1 and 3 only; d: in 1-2 and 5-6, silent between
    rows = [bad("a", 0, 0.0) + bad("b", 1, 0.5) + bad("c", 1, 0.5) + bad("a", 2, 0.5) + bad("d", 1, 1.0), bad("a", 1, 0.5) + bad("a", 3, 0.5) + bad("b", 2, 0.2) + bad("c", 2, 0.01) + bad("d", 2, 1.0), bad("c", 3, 0.9) + bad("a", 4, 0.0) + bad("d", 5, 1.0), bad("d", 6, 1.0), END]
    got = feed(spark, tmp_path, rows, "pod string, at long, status_class string, increase double", lambda s: state.error_alerts(s, ["pod"], "3 minutes", minutes=1))
    assert got == [("a", 120, "raised"), ("a", 240, "cleared"), ("b", 120, "raised"), ("b", 180, "cleared"), ("d", 120, "raised"), ("d", 180, "cleared"), ("d", 360, "raised"), ("d", 420, "cleared")]


def test_a_series_that_comes_back_is_new_again(spark, tmp_path):
    rows = [[("x", 10, None, 1.0), ("y", 70, None, 0.0), ("x", 70, None, 0.0)], [("x", 130, None, 2.0), ("x", 80, None, 0.0)], [("x", 400, None, 0.0), ("y", 130, None, 0.0)], END]
    got = feed(spark, tmp_path, rows, "pod string, at long, kind string, increase double", lambda s: state.new_series(s, ["pod"], "5 minutes", minutes=1))
    assert got == [("x", 0, 1.0, True), ("x", 120, 2.0, False), ("x", 360, 0.0, True), ("y", 60, 0.0, True)]


def test_new_series_takes_no_series_to_python(spark, tmp_path, capsys):
    stream = state.stateful_session(spark).readStream.schema("pod string, ts timestamp, increase double").parquet(str(tmp_path))
    state.new_series(stream, ["pod"], "5 minutes", minutes=1).explain()
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and not any(x in plan for x in ("Pandas", "Python", "PySpark", "Arrow"))


def test_new_series_equal_those_of_the_batch(spark):
    ts = F.timestamp_seconds(1_700_000_000 + F.col("id") * 1811 + F.pmod(F.xxhash64("id"), F.lit(1800)))
    gone = F.pmod(F.xxhash64(F.floor(F.col("id") / 12)), F.lit(3)) == 0  # hours in which a series is not seen
    samples = spark.range(3000).where(~gone).select("id", F.lit("e").alias("event_type"), (F.col("id") % 7).alias("pod"), ts.alias("ts"), F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("increase"))
    got = state_twins.stream_new_series(samples, 360)
    want = operations.new_series(operations.windowed(samples, ["event_type", "pod"], 360), ["event_type", "pod"], 360)
    rows = lambda df, at: sorted(map(tuple, df.select("event_type", "pod", at, "increase", "is_new").collect()))
    found = rows(got, "at_s")
    assert found == rows(want, F.unix_timestamp("window_start")) and {True, False} == {r[-1] for r in found}
    assert state_twins.stream_new_series(samples.limit(0), 360).count() == 0


def test_parts_arrive_in_files_of_all_tasks_and_a_batch_each(spark):
    rows = spark.range(4000, numPartitions=4).withColumn("part", F.col("id") % 2)
    got = state_twins._in_parts(spark, rows, [F.col("part") == p for p in range(2)], "arrived", lambda s: s)
    assert got.count() == 4000
    folder = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/arrived-*")[0]
    assert len(glob.glob(f"{folder}/in/*.parquet")) == 8 and len(glob.glob(f"{folder}/state/commits/[0-9]*")) == 2


@pytest.mark.parametrize("share", [0.5, 0.05, 0.011])
def test_shares_are_exact(spark, share):
    keys = [None] * 700 + ["a"] * 3000 + ["b"] * 250 + [f"k{i % 90}" for i in range(2050)] + [f"u{i}" for i in range(4000)]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    want = {k: n for k, n in Counter(keys).items() if n >= share * len(keys)}
    got = heavy.key_shares(rows, "key", share).collect()
    assert {r["key"]: r["records"] for r in got} == want and all(r["share"] == r["records"] / 10_000 for r in got)
    parts = heavy.summaries(rows, "key", 9).collect()
    missed = sum(r["missed"] for r in parts)
    assert missed <= len(keys) / 10 and sum(r["records"] for r in parts) == len(keys)
    counts = Counter()
    for r in parts:
        counts[r["key"]] += r["n"]
    assert all(counts[k] <= n <= counts[k] + missed for k, n in Counter(keys).items())
    assert heavy.key_shares(rows.limit(0), "key", share).count() == 0
