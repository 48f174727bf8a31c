"""Queries that run the streams with state by key or window over files, and must give what the batch gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions import status as S
from lumispark.operators import runs as R
from lumispark.plans import derive, flow
from lumispark.sources.shared import materialised, own_folder
from lumispark.streaming import state

DAY = 86_400


def _in_parts(spark: SparkSession, rows: DataFrame, parts: list, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives out over rows that arrive in parts (conditions), a batch each. A part is written by all tasks, in as
    many files as they make; the stream ends after it has taken them, and is started again from its checkpoint for the next.
    Before it ends, a batch without rows gives out what the watermark has passed by then, so that state stays small."""
    session, folder = state.stateful_session(spark), own_folder(spark, name)
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = session.readStream.schema(rows.schema).parquet(f"{folder}/in")
        writer = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _out_of_order(rows: DataFrame, days: int = 8, jitter: int = 2) -> tuple[DataFrame, list]:
    """Rows (ts, id) with ``part``: parts of some days, each row up to ``jitter`` days late; and the parts' conditions, in
    order. The last part is a row of null keys far ahead, which lets the watermark pass all windows before it. Rows are
    stored by part, so that one part's arrival reads no other's rows."""
    late = F.pmod(F.xxhash64("id"), F.lit(jitter * DAY))
    rows = rows.withColumn("part", F.floor((F.unix_timestamp("ts") + late) / (days * DAY))).drop("id")
    folder = own_folder(rows.sparkSession, "arrivals")
    rows.write.partitionBy("part").parquet(folder)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
    last = materialised(rows.agg(F.max("ts").alias("ts"), F.max("part").alias("part")).select((F.col("ts") + F.expr("interval 60 days")).alias("ts"), (F.col("part") + 1).alias("part")))
    return rows.unionByName(last, allowMissingColumns=True), [F.col("part") == p for p in [*parts, max(parts, default=0) + 1]]


def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current pointers of a stream whose state begins with those of the first two revisions. The rest, and half of what the
    pointers stand for again, comes in three parts; the stream is started anew for each."""
    runs = flow.derived_runs(spark, sf_dir)
    before = materialised(R.current_pointers(runs.where("light_curve_revision <= 2")).select("object_id", "run_id", "light_curve_revision"))
    user = derive.user_of(F.col("object_id"))
    rows = runs.where((F.col("light_curve_revision") > 2) | (user % 2 == 0)).select("object_id", "run_id", "light_curve_revision", F.pmod(F.xxhash64("run_id"), F.lit(3)).alias("part"))
    moves = _in_parts(spark, materialised(rows), [F.col("part") == p for p in range(3)], "resumed", lambda s: state.current_from(s, before))
    once = (F.count("*") == F.count_distinct("light_curve_revision")).alias("each_once")
    return before.unionByName(moves).groupBy("object_id").agg(F.max_by("run_id", "light_curve_revision").alias("run_id"), F.max("light_curve_revision").alias("light_curve_revision"), once)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_id", "id")


def stream_error_alerts(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    status = S.status_class(F.when(F.col("event_type") == "error", 503).otherwise(200))
    rows, parts = _out_of_order(_events(spark, sf_dir).select("id", "ts", (F.col("user_id") % 4).cast("int").alias("pod"), status.alias("status_class"), F.lit(1.0).alias("increase")))
    make = lambda s: state.error_alerts(s, ["pod"], "2 days", minutes, share=0.2, least=0.0001)
    return _in_parts(spark, rows, parts, "errors", make).where("pod is not null")


def stream_retry_alerts(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    e = _events(spark, sf_dir)
    pod = (F.col("user_id") % 5).cast("int").alias("pod")
    age = e.where("event_type = 'view'").select("id", "ts", pod, F.lit("command_age_seconds").alias("name"), (F.col("value") * 4).alias("value"))
    again = e.where("event_type = 'purchase'").select("id", "ts", pod, F.lit("commands_retrying").alias("name"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2).cast("double").alias("value"))
    rows, parts = _out_of_order(age.unionByName(again))
    return _in_parts(spark, rows, parts, "retries", lambda s: state.retry_alerts(s, "2 days", minutes, seconds=200.0)).where("pod is not null")


def stream_new_series(samples: DataFrame, minutes: int) -> DataFrame:
    """samples: id, event_type, pod, ts, increase."""
    rows, parts = _out_of_order(samples.select("id", "event_type", "pod", "ts", "increase"))
    return _in_parts(samples.sparkSession, rows, parts, "series", lambda s: state.new_series(s, ["event_type", "pod"], "2 days", minutes)).where("pod is not null")
