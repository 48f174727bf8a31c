"""Envelopes: reading topics or files of them, decoding payloads, publishing records and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.functions.columns import computed_once
from lumispark.schemas import ENVELOPE, HEADERS

# Names of the headers that a dead letter carries.
PREFIX = "x-astro-"
DLQ_HEADERS = {
    "candidate": ("error-code", "original-topic", "original-partition", "original-offset"),
    "command": ("error-code", "error-class", "error-operation", "original-topic", "original-partition", "original-offset"),
    "result": ("error-code", "error-class", "error-field", "original-topic", "original-partition", "original-offset"),
}


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of envelopes from a topic; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").load()


def read_envelope_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of envelopes from Parquet files, as they arrive in a folder: tests, replays and back-fills."""
    return spark.readStream.schema(ENVELOPE).parquet(path)


def decode(envelopes: DataFrame, schema: T.StructType, codec: str = "json", descriptor: str | None = None, message: str | None = None) -> DataFrame:
    """envelopes with ``m``, the typed record, null where the value is empty or cannot be decoded.

    codec json is the default; protobuf needs Spark's package for it, a descriptor file and the message's name."""
    if codec == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        record = from_protobuf(F.col("value"), message, descriptor, {"mode": "PERMISSIVE"})
    else:
        # a field of the wrong type empties the whole record rather than one column: no half-read message is judged
        text = F.col("value").cast("string")
        wide = T.StructType([*schema, T.StructField("_corrupt", T.StringType())])
        envelopes = computed_once(envelopes, "raw", F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        record = F.when(F.col("raw._corrupt").isNull(), F.struct(*(F.col(f"raw.{f.name}").alias(f.name) for f in schema)))
    return computed_once(envelopes, "m", F.when(F.octet_length("value") > 0, record)).drop("raw")


def encode(record: Column) -> Column:
    """The payload of a record: JSON with its fields in a fixed order, so equal records have equal bytes."""
    return F.to_json(record).cast("binary")


def dead_letters(rows: DataFrame, stage: str, topic: str, **errors: Column) -> DataFrame:
    """Dead letters of rows of envelopes: key, value, headers and time untouched, then the stage's headers behind.

    errors: error_code and, by stage, error_class, error_operation or error_field. No error text is given out."""
    own = {"original_topic": F.col("topic"), "original_partition": F.col("partition").cast("string"), "original_offset": F.col("offset").cast("string"), **errors}
    added = [F.struct(F.lit(PREFIX + h).alias("key"), own[h.replace("-", "_")].cast("binary").alias("value")) for h in DLQ_HEADERS[stage]]
    headers = F.concat(F.coalesce("headers", F.array().cast(HEADERS)), F.array(*added))
    return rows.select(F.lit(topic).alias("topic"), "key", "value", headers.alias("headers"), "timestamp")


def header(name: str) -> Column:
    """The last value of a header of the dead-letter prefix, as text."""
    found = F.filter("headers", lambda h: h["key"] == PREFIX + name)
    return F.try_element_at(found, F.lit(-1))["value"].cast("string")


def write_topic(records: DataFrame, servers: str) -> None:
    """Publish a batch; a record's own time stays in its payload, as Spark's sink cannot set it."""
    records.select("topic", "key", "value", "headers").write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()
