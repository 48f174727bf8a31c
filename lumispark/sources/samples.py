"""Metric samples: one row for each reading of a series, which is a name and a map of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.schemas import SAMPLE


def read_samples(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(ts, name, labels, value) from files of any format of Spark's; further columns are not read, missing ones are null."""
    return spark.read.schema(SAMPLE).format(form).load(path)


def readings(samples: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """ts, value and a column for each of ``labels`` of the samples of one name; a label that a series lacks is null.

    The name is a plain comparison, so that it reaches the scan."""
    own = samples.where(F.col("name") == name)
    return own.select("ts", "value", *(F.try_element_at("labels", F.lit(x)).alias(x) for x in labels))


def buckets(samples: DataFrame, name: str, by: list[str]) -> DataFrame:
    """(by, le, cumulative): the last reading of each cumulative bucket of a histogram; label le is a number or +Inf."""
    rows = readings(samples, f"{name}_bucket", [*by, "le"])
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
    return rows.withColumn("le", le).groupBy(*by, "le").agg(F.max_by("value", "ts").alias("cumulative"))
