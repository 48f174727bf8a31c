"""Runs and results: building them, the result ladder, storage constraints, idempotent saving, and the current pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.functions import vectors as V
from lumispark.functions.columns import computed_once
from lumispark.functions.identity import canonical_uuid, job_id, run_id
from lumispark.functions.status import nonzero_time, valid_time
from lumispark.operators.candidates import ladder
from lumispark.schemas import COARSE, COARSE_SOURCES, EXECUTION_MODES, FINE, LEAF, MAX_CURRENT_EPOCHS, MAX_EPOCHS, MIN_EPOCHS, RUN
from lumispark.sources.messages import dead_letters

GROUPS = {"coarse": list(COARSE), "fine": FINE, "leaf": list(LEAF)}
CURRENT, REUSED, BOOTSTRAP = (COARSE_SOURCES[k] for k in ("COMPUTED_CURRENT", "REUSED_PREVIOUS", "COMPUTED_BOOTSTRAP"))
#: The coarse source type that a mode must have been recorded with.
MODE_TYPES = {"COMPUTE_CURRENT": CURRENT, "REUSE_PREVIOUS": REUSED, "COMPUTE_BOOTSTRAP": BOOTSTRAP}


def to_result(runs: DataFrame) -> DataFrame:
    """Arrays as named groups of probabilities, the bundle under ``versions``."""
    named = {c: F.struct(*(F.get(c, F.lit(i)).alias(n.lower()) for i, n in enumerate(names))) for c, names in GROUPS.items()}
    return runs.withColumns(named).withColumn("versions", F.struct("model_bundle_version")).drop("model_bundle_version")


def from_result(m: str = "m") -> list[Column]:
    """The columns of a run from a decoded result in column m."""
    out = []
    for f in RUN:
        if f.name in GROUPS:
            whole = F.array(*(F.col(f"{m}.{f.name}.{n.lower()}") for n in GROUPS[f.name]))
            out.append(F.when(F.col(f"{m}.{f.name}").isNotNull(), whole).alias(f.name))
        else:
            out.append(F.col(f"{m}.versions.model_bundle_version" if f.name == "model_bundle_version" else f"{m}.{f.name}").alias(f.name))
    return out


def build_error() -> Column:
    """What keeps a scored task from becoming a run, by name; null if nothing. The coarse source is judged by itself, as it
    falls to another code."""
    n = F.col("n")
    sound = (F.col("candidate_revision") > 0) & F.col("execution_mode").isin(*EXECUTION_MODES.values()) & nonzero_time(F.col("completed_at"))
    sound = sound & n.between(MIN_EPOCHS, MAX_EPOCHS) & (n == F.col("actual_count")) & (n == F.col("declared_eligible_epoch_count"))
    executed = F.col("executed") == (F.col("mode") != "REUSE_PREVIOUS")
    typed = F.create_map(*(F.lit(x) for p in MODE_TYPES.items() for x in p))[F.col("mode")] == F.col("coarse_source_type")
    return F.when(~F.coalesce(sound & executed, F.lit(False)), "RUN_INVALID").when(~F.coalesce(typed & source_relation(), F.lit(False)), "COARSE_SOURCE_INVALID")


def build_runs(scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs of scored tasks: run id, source columns and the classes of the first maximum. Tasks with a ``build_error`` give
    none; see ``unbuilt``. ``keep``: columns of the tasks that stay."""
    rows = scored.withColumn("run_id", run_id(F.col("job_id"))).withColumn("effective_epoch_count", F.col("n")).where(build_error().isNull())
    rows = rows.withColumn("predicted_coarse_class", V.class_of(F.col("coarse"), COARSE)).withColumn("predicted_leaf_class", V.class_of(F.col("leaf"), LEAF))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in RUN), *keep)


def unbuilt(scored: DataFrame) -> DataFrame:
    """Scored tasks that give no run, with ``cause`` and ``failure`` (class, code): an inconsistent one is an invalid result, a
    coarse source that does not fit the mode an internal error."""
    rows = scored.withColumn("effective_epoch_count", F.col("n")).withColumn("cause", build_error()).where("cause is not null")
    code = F.when(F.col("cause") == "RUN_INVALID", "CLASSIFICATION_RESULT_INVALID").otherwise("WORKER_INTERNAL_INVALID")
    return rows.withColumn("failure", F.struct(F.lit("PERMANENT").alias("class"), code.alias("code"))).drop("effective_epoch_count")


def source_relation() -> Column:
    """Source type, epochs, source run and executed flag fit each other."""
    n = F.col("effective_epoch_count")
    own = F.col("coarse_source_run_id").isNull() & (F.col("coarse_source_light_curve_revision") == F.col("light_curve_revision")) & (F.col("coarse_source_epoch_count") == n) & F.col("xgboost_executed")
    earlier = (
        F.col("coarse_source_run_id").isNotNull()
        & (F.col("coarse_source_light_curve_revision") > 0)
        & (F.col("coarse_source_light_curve_revision") < F.col("light_curve_revision"))
        & F.col("coarse_source_epoch_count").between(MIN_EPOCHS, MAX_EPOCHS)
        & ~F.col("xgboost_executed")
    )
    kind = F.col("coarse_source_type")
    few = n <= MAX_CURRENT_EPOCHS
    return F.coalesce(((kind == CURRENT) & few & own) | ((kind == REUSED) & ~few & earlier) | ((kind == BOOTSTRAP) & ~few & own), F.lit(False))


def validate_results(decoded: DataFrame, topic: str) -> DataFrame:
    """Envelopes of results with the columns of a run and ``error``; ids are made again, once, before the ladder."""
    rows = decoded.select("*", *from_result())
    rows = computed_once(rows, "expected_job_id", job_id(F.col("object_id"), F.col("light_curve_revision"), F.col("model_bundle_version"), F.col("execution_mode")))
    rows = computed_once(rows, "expected_run_id", run_id(F.col("expected_job_id")))
    bad = "RESULT_FIELD_INVALID"
    c = F.col
    rungs = (
        (c("topic") == topic, "RESULT_TOPIC_UNEXPECTED", "topic"),
        (F.octet_length("key") > 0, bad, "key"),
        (c("m").isNotNull(), "RESULT_MESSAGE_MALFORMED", "value"),
        (c("m.versions").isNotNull(), bad, "versions"),
        (c("m.coarse").isNotNull(), bad, "coarse_probabilities"),
        (c("m.fine").isNotNull(), bad, "fine_conditional_probabilities"),
        (c("m.leaf").isNotNull(), bad, "leaf_probabilities"),
        (valid_time(c("completed_at")), bad, "completed_at"),
        (c("coarse_source_run_id").isNull() | canonical_uuid(c("coarse_source_run_id")), bad, "coarse_source_run_id"),
        (c("key").cast("string") == c("object_id"), "RESULT_KEY_MISMATCH", "key"),
        (c("expected_job_id").isNotNull(), bad, "job_identity"),
        (c("job_id") == c("expected_job_id"), "RESULT_JOB_ID_MISMATCH", "job_id"),
        (c("run_id") == c("expected_run_id"), "RESULT_RUN_ID_MISMATCH", "run_id"),
        (F.length("object_id") > 0, bad, "object_id"),
        (c("candidate_revision") > 0, bad, "candidate_revision"),
        (c("light_curve_revision") > 0, bad, "light_curve_revision"),
        (c("effective_epoch_count").between(MIN_EPOCHS, MAX_EPOCHS), bad, "effective_epoch_count"),
        (c("execution_mode").isin(*EXECUTION_MODES.values()), bad, "execution_mode"),
        (c("coarse_source_type").isin(*COARSE_SOURCES.values()), bad, "coarse_source_type"),
        (F.length("model_bundle_version") > 0, bad, "model_bundle_version"),
        (c("predicted_coarse_class").isin(*COARSE.values()), bad, "predicted_coarse_class"),
        (c("predicted_leaf_class").isin(*LEAF.values()), bad, "predicted_leaf_class"),
        (nonzero_time(c("completed_at")), bad, "completed_at"),
        (c("predicted_coarse_class") == V.class_of(c("coarse"), COARSE), bad, "predicted_coarse_class"),
        (c("predicted_leaf_class") == V.class_of(c("leaf"), LEAF), bad, "predicted_leaf_class"),
        (source_relation(), bad, "coarse_source"),
    )
    return computed_once(rows, "error", ladder(*rungs))


def result_dead_letters(validated: DataFrame, topic: str) -> DataFrame:
    return dead_letters(validated.where("error is not null"), "result", topic, error_code=F.col("error.code"), error_class=F.lit("PERMANENT"), error_field=F.col("error.field"))


def violated_constraints() -> Column:
    """Names of the storage constraints that a run breaks, in order: weaker than the ladder in places, and not a part of it."""
    c = F.col
    trimmed = lambda s: (s != "") & (s == F.btrim(s))
    shape = lambda s, n: (F.size(s) == n) & F.forall(s, lambda x: x.isNotNull())
    own = c("coarse_source_run_id").isNull() & (c("coarse_source_light_curve_revision") == c("light_curve_revision")) & (c("coarse_source_epoch_count") == c("effective_epoch_count")) & c("xgboost_executed")
    other = c("coarse_source_run_id").isNotNull() & (c("coarse_source_light_curve_revision") < c("light_curve_revision")) & ~c("xgboost_executed")
    checks = {
        "object_id": trimmed(c("object_id")),
        "candidate_revision": c("candidate_revision") > 0,
        "light_curve_revision": c("light_curve_revision") > 0,
        "effective_epoch_count": c("effective_epoch_count") >= MIN_EPOCHS,
        "execution_mode": c("execution_mode").isin(1, 2, 3),
        "coarse_source_type": c("coarse_source_type").isin(1, 2, 3),
        "coarse_source_revision": c("coarse_source_light_curve_revision") > 0,
        "coarse_source_epoch_count": c("coarse_source_epoch_count") >= MIN_EPOCHS,
        "coarse_source_not_self": c("coarse_source_run_id").isNull() | (c("coarse_source_run_id") != c("run_id")),
        "coarse_source_consistency": (c("coarse_source_type").isin(CURRENT, BOOTSTRAP) & own) | ((c("coarse_source_type") == REUSED) & other),
        "model_bundle_version": trimmed(c("model_bundle_version")),
        "coarse_probabilities_shape": shape(c("coarse"), 7),
        "fine_probabilities_shape": shape(c("fine"), 10),
        "leaf_probabilities_shape": shape(c("leaf"), 12),
        "predicted_coarse_class": c("predicted_coarse_class").isin(*COARSE.values()),
        "predicted_leaf_class": c("predicted_leaf_class").isin(*LEAF.values()),
    }
    named = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()))
    return F.filter(named, lambda x: x.isNotNull())


def save_outcomes(incoming: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """incoming runs (with partition, offset: their arrival) with ``outcome``, ``inserted``, ``advanced``.

    As one by one in order of arrival: the first of a job that is not stored is inserted; the same run again is a no-op; a
    known job with another run id, or a known run id with another job, is a conflict. An inserted PRODUCTION run advances
    the current pointer of its object if its revision is strictly greater than all that were current before it: stored, or
    inserted earlier in the batch. A replay advances nothing. Windows are by job (a hash, evenly dealt) and by object.
    """
    by_job = stored.select("job_id", F.col("run_id").alias("stored_run"))
    by_run = stored.select("run_id", F.col("job_id").alias("stored_job"))
    rows = incoming.join(by_job, "job_id", "left").join(by_run, "run_id", "left")
    arrival = ["partition", "offset"]
    first = Window.partitionBy("job_id").orderBy(*arrival)
    rows = rows.withColumn("place", F.row_number().over(first)).withColumn("first_run", F.coalesce("stored_run", F.first("run_id").over(first)))
    clash = (F.col("first_run") != F.col("run_id")) | (F.col("stored_job").isNotNull() & (F.col("stored_job") != F.col("job_id")))
    new = F.col("stored_run").isNull() & F.col("stored_job").isNull() & (F.col("place") == 1)
    rows = rows.withColumn("outcome", F.when(F.coalesce(clash, F.lit(False)), "RESULT_REPOSITORY_CONFLICT").when(new, "INSERTED").otherwise("NO_OP"))
    rows = rows.withColumn("inserted", F.col("outcome") == "INSERTED")
    pointer = current.select("object_id", F.col("light_curve_revision").alias("current_revision"))
    rows = rows.join(pointer, "object_id", "left")
    moves = F.col("inserted") & (F.col("execution_mode") == EXECUTION_MODES["PRODUCTION"])
    before = Window.partitionBy("object_id").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.greatest(F.max(F.when(moves, F.col("light_curve_revision"))).over(before), F.col("current_revision"))
    advanced = moves & (highest.isNull() | (F.col("light_curve_revision") > highest))
    return rows.withColumn("advanced", advanced).drop("place", "first_run", "stored_run", "stored_job", "current_revision")


def current_pointers(runs: DataFrame) -> DataFrame:
    """(object_id, run_id, light_curve_revision, updated_at) of runs with arrival columns: the greatest PRODUCTION revision,
    the earliest arrival of equal ones. A maximum, so it is combined before the shuffle and no object is a bottleneck."""
    rows = runs.where(F.col("execution_mode") == EXECUTION_MODES["PRODUCTION"])
    best = F.max_by(F.struct("run_id", "light_curve_revision", F.col("completed_at").alias("updated_at")), F.struct("light_curve_revision", -F.col("partition"), -F.col("offset")))
    return rows.groupBy("object_id").agg(best.alias("b")).select("object_id", "b.*")


def merge_current(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pointers with new ones (as of ``current_pointers``): of an object the greater revision, the stored one of equals."""
    both = stored.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
    best = F.max_by(F.struct("run_id", "light_curve_revision", "updated_at"), F.struct("light_curve_revision", "old"))
    return both.groupBy("object_id").agg(best.alias("b")).select("object_id", "b.*")


def current_view(current: DataFrame, runs: DataFrame) -> DataFrame:
    """Current pointers with their whole runs, on run, object and revision."""
    return current.select("object_id", "run_id", "light_curve_revision", "updated_at").join(runs, ["run_id", "object_id", "light_curve_revision"])


def integrity(runs: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, id): reused runs whose source is missing, and pointers whose run is missing."""
    lost = runs.where("coarse_source_run_id is not null").join(runs.select(F.col("run_id").alias("coarse_source_run_id")), "coarse_source_run_id", "left_anti")
    stray = current.join(runs.select("run_id"), "run_id", "left_anti")
    return lost.select(F.lit("source_run").alias("kind"), F.col("run_id").alias("id")).unionByName(stray.select(F.lit("current_run").alias("kind"), F.col("run_id").alias("id")))


def replay_gap(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results of the log whose run is not in the table: what a restore has to replay."""
    return results.join(runs.select("run_id"), "run_id", "left_anti")


def outcome_counts(saved: DataFrame) -> DataFrame:
    return saved.groupBy("outcome", "inserted", "advanced").agg(F.count("*").alias("attempts"))


def history(runs: DataFrame) -> DataFrame:
    """Runs of each object, newest revision first; laid out by object for writing."""
    return runs.repartition("object_id").sortWithinPartitions("object_id", F.desc("light_curve_revision"), F.desc("completed_at"), F.desc("run_id"))


def table_counts(runs: DataFrame, current: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("rows")).withColumn("table", F.lit("classification_runs")).unionByName(current.agg(F.count("*").alias("rows")).withColumn("table", F.lit("current_classifications")))
