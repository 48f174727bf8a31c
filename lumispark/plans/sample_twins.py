"""Queries that read metric samples with label maps, and keyed state as a stream, and must give what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.operators import operations
from lumispark.plans import flow
from lumispark.schemas import SAMPLE
from lumispark.sources.samples import buckets, read_samples, readings
from lumispark.sources.shared import own_folder
from lumispark.streaming import pipelines


def _labels(**columns: str):
    return F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("string"))))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Samples as they are read from the files that a metrics job would leave."""
    folder = own_folder(rows.sparkSession, name)
    rows.select(*(F.col(f.name).cast(f.dataType) for f in SAMPLE)).write.parquet(f"{folder}/samples")
    return read_samples(rows.sparkSession, f"{folder}/samples")


def sample_rates(counters: DataFrame, minutes: int) -> DataFrame:
    """Rates by window and event type of counters (event_type, pod, ts, value) that went through the sample source, beside
    samples of another name, which are no part of them."""
    rows = counters.withColumn("labels", _labels(event_type="event_type", pod="pod")).withColumn("name", F.lit("cents_total"))
    other = rows.withColumn("name", F.lit("cents_created")).withColumn("value", F.lit(1.0))
    samples = readings(_written(rows.unionByName(other), "counters"), "cents_total", ["event_type", "pod"])
    return operations.windowed(operations.increases(samples, ["event_type", "pod"]), ["event_type"], minutes)


def sample_quantiles(histogram: DataFrame, q: float) -> DataFrame:
    """Quantiles of cumulative buckets (event_type, le, cumulative) that went through the sample source. Each bucket was
    read twice, first when it held half."""
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    rows = histogram.withColumn("le", le).withColumn("labels", _labels(event_type="event_type", le="le")).withColumn("name", F.lit("value_bucket"))
    reading = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(0.5).alias("share")), F.struct(F.lit(60).alias("at"), F.lit(1.0).alias("share"))))
    rows = rows.withColumn("r", reading).select("name", "labels", F.timestamp_seconds("r.at").alias("ts"), (F.col("cumulative") * F.col("r.share")).alias("value"))
    return operations.bucket_quantile(buckets(_written(rows, "buckets"), "value", ["event_type"]), ["event_type"], q)


def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last move of each object's pointer in a stream of runs, one file a batch, with the pointer as keyed state; and
    whether every move went to a revision of its own."""
    runs = flow.derived_runs(spark, sf_dir).select("object_id", "run_id", "light_curve_revision")
    folder = own_folder(spark, "moves")
    runs.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    moves = pipelines.running_current(stream)
    moves.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    last = F.max_by("run_id", "light_curve_revision").alias("run_id")
    once = (F.count("*") == F.count_distinct("light_curve_revision")).alias("each_once")
    return spark.read.parquet(f"{folder}/out").groupBy("object_id").agg(last, F.max("light_curve_revision").alias("light_curve_revision"), once)
