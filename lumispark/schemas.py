"""Frozen vocabularies, limits and table schemas. Revisions and counts are BIGINT; probabilities and magnitudes FLOAT."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the record contract: ids, label orders, limits and names that results must agree with.
EVENT_TYPES = {"CREATED": 1, "UPDATED": 2, "RETRACTED": 3}
EXECUTION_MODES = {"PRODUCTION": 1, "SHADOW": 2, "REPROCESS": 3}
PRIORITIES = {"REALTIME": 1, "NORMAL": 2, "BATCH": 3}
COARSE_SOURCES = {"COMPUTED_CURRENT": 1, "REUSED_PREVIOUS": 2, "COMPUTED_BOOTSTRAP": 3}
COARSE = {"ROTATING": 50, "CATACLYSMIC": 30, "ECLIPSING_BINARY": 60, "LONG_PERIOD": 20, "PULSATING": 10, "RR_LYRAE": 40, "SUPERNOVA": 70}
LEAF = {"EW": 6001, "EA": 6002, "BY_DRA": 5001, "RS_CVN": 5002, "RRAB": 4001, "RRC": 4002, "SR": 2001, "MIRA": 2002, "DSCT": 1001, "CEP": 1002, "CATACLYSMIC": 30, "SUPERNOVA": 70}
FINE = list(LEAF)[:10]
PARENT = {"EW": "ECLIPSING_BINARY", "EA": "ECLIPSING_BINARY", "BY_DRA": "ROTATING", "RS_CVN": "ROTATING", "RRAB": "RR_LYRAE", "RRC": "RR_LYRAE", "SR": "LONG_PERIOD", "MIRA": "LONG_PERIOD", "DSCT": "PULSATING", "CEP": "PULSATING"}
MIN_EPOCHS, MAX_EPOCHS, MAX_CURRENT_EPOCHS = 3, 1024, 20
LENGTH_BUCKETS = (32, 64, 128, 256, 512, 768, 1024)
TIME_HEADERS = ("time", "time_mjd", "mjd", "observation_time")
MAGNITUDE_HEADERS = ("magnitude", "mag")
ERROR_HEADERS = ("magnitude_error", "mag_err", "magerror", "error")

HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
HEADERS = T.ArrayType(HEADER)
#: Columns of Spark's Kafka source with headers; files of envelopes have the same.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", HEADERS),
    ]
)
TRACE = T.StructType([T.StructField(c, T.StringType()) for c in ("trace_id", "correlation_id", "causation_id")])
EPOCHS = T.ArrayType(T.StructType([T.StructField("observation_time", T.DoubleType()), T.StructField("magnitude", T.FloatType()), T.StructField("magnitude_error", T.FloatType())]))


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "t": T.TimestampType(), "b": T.BooleanType(), "trace": TRACE, "f": T.ArrayType(T.FloatType()), "epochs": EPOCHS}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CANDIDATE = _struct(
    "event_id:s event_type:i object_id:s candidate_revision:l light_curve_revision:l eligible_epoch_count:l occurred_at:t producer:s upstream_pipeline_version:s quality_policy_version:s trigger_reason:s trace:trace"
)
COMMAND = _struct("job_id:s object_id:s candidate_revision:l light_curve_revision:l declared_eligible_epoch_count:l model_bundle_version:s execution_mode:i priority:i created_at:t deadline_at:t trace:trace")
RUN = _struct(
    "run_id:s job_id:s object_id:s candidate_revision:l light_curve_revision:l effective_epoch_count:l execution_mode:i coarse_source_type:i coarse_source_run_id:s coarse_source_light_curve_revision:l coarse_source_epoch_count:l xgboost_executed:b model_bundle_version:s coarse:f fine:f leaf:f predicted_coarse_class:i predicted_leaf_class:i completed_at:t"
)
REVISION_DOCUMENT = _struct("object_id:s light_curve_revision:l eligible_epoch_count:l quality_policy_version:s epochs:epochs")
SAMPLE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("name", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType())), T.StructField("value", T.DoubleType())])


def result_schema() -> T.StructType:
    """A result message: a run with its probabilities as named groups and its bundle under ``versions``."""
    group = lambda names: T.StructType([T.StructField(n.lower(), T.FloatType()) for n in names])
    groups = {"coarse": group(COARSE), "fine": group(FINE), "leaf": group(LEAF)}
    fields = [T.StructField(f.name, groups.get(f.name, f.dataType)) for f in RUN if f.name != "model_bundle_version"]
    return T.StructType([*fields, T.StructField("versions", T.StructType([T.StructField("model_bundle_version", T.StringType())])), T.StructField("trace", TRACE)])
