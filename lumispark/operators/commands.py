"""Commands: the validation ladder and dead letters of work that failed for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.functions.columns import computed_once
from lumispark.functions.identity import good_string, job_id
from lumispark.functions.status import nonzero_time, valid_time
from lumispark.operators.candidates import ladder
from lumispark.schemas import EXECUTION_MODES, MIN_EPOCHS, PRIORITIES
from lumispark.sources.messages import dead_letters


def command_error(topic: str) -> Column:
    """Of decoded envelopes with ``expected_job_id``, which is made before, so that the ladder computes it once."""
    bad = "COMMAND_FIELD_INVALID"
    m = lambda c: F.col(f"m.{c}")
    return ladder(
        (F.col("topic") == topic, "COMMAND_TOPIC_UNEXPECTED", "topic"),
        (F.octet_length("key") > 0, "COMMAND_KEY_MISSING", "key"),
        (F.col("m").isNotNull(), "COMMAND_PROTO_MALFORMED", "value"),
        (good_string(m("job_id")), bad, "job_id"),
        (good_string(m("object_id")), bad, "object_id"),
        (m("candidate_revision") > 0, bad, "candidate_revision"),
        (m("light_curve_revision") > 0, bad, "light_curve_revision"),
        (m("declared_eligible_epoch_count") >= MIN_EPOCHS, bad, "declared_eligible_epoch_count"),
        (good_string(m("model_bundle_version")), bad, "model_bundle_version"),
        (m("execution_mode").isin(*EXECUTION_MODES.values()), "COMMAND_EXECUTION_MODE_UNSUPPORTED", "execution_mode"),
        (m("priority") == PRIORITIES["REALTIME"], "COMMAND_PRIORITY_UNSUPPORTED", "priority"),
        (valid_time(m("created_at")) & nonzero_time(m("created_at")), bad, "created_at"),
        (m("deadline_at").isNull(), "COMMAND_DEADLINE_UNSUPPORTED", "deadline_at"),
        (F.col("key").cast("string") == m("object_id"), "COMMAND_KEY_MISMATCH", "key"),
        (m("job_id") == F.col("expected_job_id"), "COMMAND_JOB_ID_MISMATCH", "job_id"),
    )


def validate_commands(decoded: DataFrame, topic: str) -> DataFrame:
    expected = job_id(F.col("m.object_id"), F.col("m.light_curve_revision"), F.col("m.model_bundle_version"), F.col("m.execution_mode"))
    return computed_once(computed_once(decoded, "expected_job_id", expected), "error", command_error(topic))


def command_dead_letters(failed: DataFrame, topic: str) -> DataFrame:
    """Of envelopes with ``failure`` (class, code) and ``operation``: the permanent ones only; retryable ones stay pending."""
    return dead_letters(
        failed.where("failure.class = 'PERMANENT'"), "command", topic, error_code=F.col("failure.code"), error_class=F.col("failure.class"), error_operation=F.col("operation")
    )
