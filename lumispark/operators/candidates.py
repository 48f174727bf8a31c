"""Candidate events: the validation ladder, the classification policy, commands and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.functions.columns import computed_once
from lumispark.functions.identity import good_string, job_id
from lumispark.functions.status import nonzero_time, valid_time
from lumispark.schemas import EVENT_TYPES, EXECUTION_MODES, MIN_EPOCHS, PRIORITIES
from lumispark.sources.messages import dead_letters, encode


def ladder(*rungs: tuple[Column, str, str]) -> Column:
    """The first failing rung as STRUCT(code, field), null if all hold. A rung: (what must hold, code, field); null fails."""
    out = None
    for good, code, field in rungs:
        failed = ~F.coalesce(good, F.lit(False))
        error = F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))
        out = F.when(failed, error) if out is None else out.when(failed, error)
    return out


def candidate_error(topic: str) -> Column:
    """Of decoded envelopes (``m`` null if malformed)."""
    bad = "CANDIDATE_EVENT_INVALID"
    m = lambda c: F.col(f"m.{c}")
    return ladder(
        (F.col("topic") == topic, "CANDIDATE_TOPIC_UNEXPECTED", "topic"),
        (F.octet_length("key") > 0, "CANDIDATE_KEY_MISSING", "key"),
        (F.col("m").isNotNull(), "CANDIDATE_PROTO_MALFORMED", "value"),
        (m("event_type").isin(EVENT_TYPES["CREATED"], EVENT_TYPES["UPDATED"]), "CANDIDATE_EVENT_TYPE_UNSUPPORTED", "event_type"),
        (good_string(m("event_id")), bad, "event_id"),
        (good_string(m("object_id")), bad, "object_id"),
        (m("candidate_revision") > 0, bad, "candidate_revision"),
        (m("light_curve_revision") > 0, bad, "light_curve_revision"),
        (m("eligible_epoch_count") >= MIN_EPOCHS, bad, "eligible_epoch_count"),
        (F.col("key").cast("string") == m("object_id"), "CANDIDATE_KEY_MISMATCH", "key"),
        # year 1 itself is a valid time but no command can be built from it: a dead letter here, as it would block for ever
        (valid_time(m("occurred_at")) & nonzero_time(m("occurred_at")), bad, "occurred_at"),
        (good_string(m("producer")), bad, "producer"),
        (good_string(m("upstream_pipeline_version")), bad, "upstream_pipeline_version"),
    )


def validate_candidates(decoded: DataFrame, topic: str) -> DataFrame:
    """decoded envelopes with ``error``: one tagged table of all outcomes, so no row is lost and none is read twice."""
    return computed_once(decoded, "error", candidate_error(topic))


def passed_over() -> Column:
    """Valid candidates that the policy lets fall: they give neither a command nor a dead letter."""
    return F.col("error").isNull() & ~F.coalesce(F.col("m.eligible_epoch_count") >= MIN_EPOCHS, F.lit(False))


def commands(validated: DataFrame, bundle: str, topic: str) -> DataFrame:
    """Command records of valid candidates that the policy lets through (3 epochs or more), one for each candidate.

    The id is computed; a command is created when its event occurred, not now, so a replay gives the same bytes."""
    m = lambda c: F.col(f"m.{c}")
    rows = validated.where(F.col("error").isNull() & (m("eligible_epoch_count") >= MIN_EPOCHS))
    mode, version = F.lit(EXECUTION_MODES["PRODUCTION"]), F.lit(bundle)
    empty = F.coalesce(m("trace.trace_id"), m("trace.correlation_id"), m("trace.causation_id")).isNull()
    rows = rows.select(
        job_id(m("object_id"), m("light_curve_revision"), version, mode).alias("job_id"),
        m("object_id").alias("object_id"),
        m("candidate_revision").alias("candidate_revision"),
        m("light_curve_revision").alias("light_curve_revision"),
        m("eligible_epoch_count").alias("declared_eligible_epoch_count"),
        version.alias("model_bundle_version"),
        mode.alias("execution_mode"),
        F.lit(PRIORITIES["REALTIME"]).alias("priority"),
        m("occurred_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("deadline_at"),
        F.when(~empty, m("trace")).alias("trace"),
        "headers",
    )
    fields = [c for c in rows.columns if c != "headers"]
    rows = computed_once(rows, "job_id", F.col("job_id")).select(*fields, "headers")
    return rows.withColumn("topic", F.lit(topic)).withColumn("key", F.col("object_id").cast("binary")).withColumn("value", encode(F.struct(*fields)))


def candidate_dead_letters(validated: DataFrame, topic: str) -> DataFrame:
    return dead_letters(validated.where("error is not null"), "candidate", topic, error_code=F.col("error.code"))


def seed_candidates(revisions: DataFrame, prefix: str, producer: str, pipeline: str) -> DataFrame:
    """One CREATED candidate for each revision (object_id, light_curve_revision, eligible_epoch_count, occurred_at): the
    seed of a reprocessing. The event id names prefix, object and revision, and the trace is made of it."""
    event = F.concat_ws(":", F.lit(prefix), "object_id", F.col("light_curve_revision").cast("string"))
    return revisions.select(
        event.alias("event_id"),
        F.lit(EVENT_TYPES["CREATED"]).alias("event_type"),
        "object_id",
        F.col("light_curve_revision").alias("candidate_revision"),
        "light_curve_revision",
        "eligible_epoch_count",
        "occurred_at",
        F.lit(producer).alias("producer"),
        F.lit(pipeline).alias("upstream_pipeline_version"),
        F.lit(None).cast("string").alias("quality_policy_version"),
        F.lit(None).cast("string").alias("trigger_reason"),
        F.struct(event.alias("trace_id"), event.alias("correlation_id"), F.lit(None).cast("string").alias("causation_id")).alias("trace"),
    )
