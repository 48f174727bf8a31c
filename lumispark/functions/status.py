"""Names, classes and codes: enum names, HTTP labels, and the class and code of a failure cause."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure cause -> (class, code).
CAUSES = {
    "CANCELLED": ("CANCELLED", "WORKER_CANCELLED"),
    "REVISION_NOT_FOUND": ("PERMANENT", "LIGHT_CURVE_NOT_FOUND"),
    "REVISION_NOT_READY": ("RETRYABLE", "LIGHT_CURVE_NOT_READY"),
    "SOURCE_UNAVAILABLE": ("RETRYABLE", "LIGHT_CURVE_UNAVAILABLE"),
    "REVISION_INCONSISTENT": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "IDENTITY_MISMATCH": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "EPOCH_COUNT_MISMATCH": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "TOO_FEW_EPOCHS": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "TOO_MANY_EPOCHS": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "BAD_TIME": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "BAD_MAGNITUDE": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "BAD_MAGNITUDE_ERROR": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "DUPLICATE_TIME": ("PERMANENT", "LIGHT_CURVE_INVALID"),
    "BUNDLE_NOT_FOUND": ("PERMANENT", "MODEL_BUNDLE_NOT_FOUND"),
    "BUNDLE_INVALID": ("PERMANENT", "MODEL_BUNDLE_INVALID"),
    "COARSE_RESULT_INVALID": ("PERMANENT", "MODEL_BUNDLE_INVALID"),
    "MODE_INVALID": ("PERMANENT", "MODEL_BUNDLE_INVALID"),
    "RUN_INVALID": ("PERMANENT", "CLASSIFICATION_RESULT_INVALID"),
    "COARSE_SOURCE_INVALID": ("PERMANENT", "WORKER_INTERNAL_INVALID"),
}
#: What an unnamed failure of an operation means.
OPERATIONS = {
    "prepare-input": ("RETRYABLE", "DEPENDENCY_UNAVAILABLE"),
    "resolve-serving-bundle": ("RETRYABLE", "DEPENDENCY_UNAVAILABLE"),
    "classify": ("RETRYABLE", "DEPENDENCY_UNAVAILABLE"),
    "publish-result": ("RETRYABLE", "RESULT_PUBLISH_FAILED"),
    "publish-command-dlq": ("RETRYABLE", "COMMAND_DLQ_PUBLISH_FAILED"),
    "build-command-dlq": ("PERMANENT", "COMMAND_DLQ_INVALID"),
}
RETRYABLE_STATUSES = (408, 425, 429)


def _lookup(table: dict, key: Column, part: int) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[part])) for k, v in table.items()))[key]


def failure(cause: Column, operation: Column, http_status: Column | None = None) -> Column:
    """STRUCT(class, code): by the named cause, else by the HTTP status, else by the operation, else an internal error."""
    status = http_status if http_status is not None else F.lit(None).cast("int")
    again = status.isin(*RETRYABLE_STATUSES) | status.between(500, 599)
    by_status = lambda yes, no: F.when(status.isNotNull(), F.when(again, yes).otherwise(no))
    return F.struct(
        F.coalesce(_lookup(CAUSES, cause, 0), by_status("RETRYABLE", "PERMANENT"), _lookup(OPERATIONS, operation, 0), F.lit("PERMANENT")).alias("class"),
        F.coalesce(_lookup(CAUSES, cause, 1), by_status("TRITON_UNAVAILABLE", "TRITON_REQUEST_REJECTED"), _lookup(OPERATIONS, operation, 1), F.lit("WORKER_INTERNAL_INVALID")).alias("code"),
    )


def name_of(value: Column, names: dict[str, int]) -> Column:
    """The name of an id; null for an unknown one."""
    return F.create_map(*chain.from_iterable((F.lit(i), F.lit(n)) for n, i in names.items()))[value]


def status_class(status: Column) -> Column:
    """2xx to 5xx (and 1xx), transport_error where there is none, other."""
    return F.when(status.isNull(), "transport_error").when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


def method_label(method: Column) -> Column:
    """GET and POST by name, byte for byte; any other method, or none, is OTHER, so that labels stay few."""
    return F.when(method.isin("GET", "POST"), method).otherwise("OTHER")


def valid_time(t: Column) -> Column:
    """Present and within years 1 to 9999."""
    return F.coalesce(t.between(F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp")), F.lit(False))


def nonzero_time(t: Column) -> Column:
    return F.coalesce(t != F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit(False))
