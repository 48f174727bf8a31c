"""Light-curve text files and revision documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions.identity import good_string
from lumispark.functions.vectors import parse_number
from lumispark.schemas import ERROR_HEADERS, MAGNITUDE_HEADERS, REVISION_DOCUMENT, TIME_HEADERS


def read_light_curve_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(epochs, errors) of the .csv and .txt files of a folder, whatever the case of the extension.

    epochs: object_id (the file's stem), line, observation_time, magnitude, magnitude_error. errors: path, object_id,
    reason (bad_name, duplicate_name, columns, number, empty) and the first line it is about. A file with an error gives
    no epochs; the others are read all the same. Lines are trimmed; blank ones and those from # on are left out; fields
    are parted by commas if there is one, else by white space; the first line left may be a header.
    Files are small (a megabyte at most), so each is read whole and its lines keep their order.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{csv,CSV,txt,TXT,Csv,Txt}").select("value", F.col("_metadata.file_path").alias("path"))
    return parse_light_curve_files(files)


def parse_light_curve_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_light_curve_files``, from rows of (path, value)."""
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    files = files.withColumn("object_id", F.regexp_replace(name, r"(?i)\.(csv|txt)$", ""))
    lines = files.select("path", "object_id", F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    lines = lines.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    fields = F.when(F.col("text").contains(","), F.transform(F.split("text", ",", -1), lambda x: F.trim(x))).otherwise(F.split("text", r"\s+"))
    first = lines.groupBy("path").agg(F.min("line").alias("first"))
    lines = lines.withColumn("f", fields).join(first, "path")
    low = lambda i: F.lower(F.get("f", F.lit(i)))
    header = (F.col("line") == F.col("first")) & (F.size("f") == 3) & low(0).isin(*TIME_HEADERS) & low(1).isin(*MAGNITUDE_HEADERS) & low(2).isin(*ERROR_HEADERS)
    number = lambda i, kind: parse_number(F.get("f", F.lit(i)), kind)
    rows = lines.where(~F.coalesce(header, F.lit(False))).select(
        "path", "object_id", "line", (F.size("f") == 3).alias("three"), number(0, "double").alias("observation_time"), number(1, "float").alias("magnitude"), number(2, "float").alias("magnitude_error")
    )
    unread = F.col("observation_time").isNull() | F.col("magnitude").isNull() | F.col("magnitude_error").isNull()
    bad = F.when(~F.col("three"), F.struct("line", F.lit("columns").alias("reason"))).when(unread, F.struct("line", F.lit("number").alias("reason")))
    per_file = files.select("path", "object_id").join(rows.groupBy("path").agg(F.min(bad).alias("bad")), "path", "left").join(rows.select("path").distinct().withColumn("some", F.lit(True)), "path", "left")
    twice = files.groupBy("object_id").agg((F.count("*") > 1).alias("twice"))
    reason = (
        F.when(~good_string(F.col("object_id")), "bad_name").when(F.col("twice"), "duplicate_name").when(F.col("some").isNull(), "empty").otherwise(F.col("bad.reason"))
    )
    judged = per_file.join(twice, "object_id").select("path", "object_id", reason.alias("reason"), (F.col("bad.line") + 1).alias("line"))
    good = rows.join(judged.where("reason is null").select("path"), "path", "left_semi").select("object_id", "line", "observation_time", "magnitude", "magnitude_error")
    return good, judged.where("reason is not null")


def read_revision_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON line: the document, and ``consistent``. Unknown fields are ignored; a document that cannot be
    decoded, or lacks a field it must have (all but the quality policy), is not consistent."""
    return parse_revision_documents(spark.read.text(path).withColumnRenamed("value", "document"))


def parse_revision_documents(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("document", REVISION_DOCUMENT, {"mode": "PERMISSIVE"})
    rows = rows.withColumn("d", parsed)
    lacks = F.exists("d.epochs", lambda e: e["observation_time"].isNull() | e["magnitude"].isNull() | e["magnitude_error"].isNull())
    whole = F.col("d.object_id").isNotNull() & F.col("d.light_curve_revision").isNotNull() & F.col("d.eligible_epoch_count").isNotNull() & F.col("d.epochs").isNotNull() & ~F.coalesce(lacks, F.lit(True))
    return rows.select("d.*", F.coalesce(whole, F.lit(False)).alias("consistent"))
