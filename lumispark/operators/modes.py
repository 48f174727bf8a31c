"""Coarse mode of each task: compute now, reuse an earlier run's coarse vector, or bootstrap; by strict as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.schemas import MAX_CURRENT_EPOCHS, MAX_EPOCHS, MIN_EPOCHS

PAIR = ["object_id", "model_bundle_version"]
#: The part of a run that a lookup returns.
SOURCE = "struct<light_curve_revision:bigint,persisted_at:timestamp,run_id:string,effective_epoch_count:bigint,coarse:array<float>>"


def resolve_bundles(tasks: DataFrame, bundles: DataFrame, few: int = 10_000) -> DataFrame:
    """tasks with ``bundle_found``; exact version only. Bundles are a small dimension: broadcast while it has ``few`` rows."""
    known = bundles.select("model_bundle_version").distinct().withColumn("bundle_found", F.lit(True))
    small = known.limit(few + 1).count() <= few
    return tasks.join(F.broadcast(known) if small else known, "model_bundle_version", "left").withColumn("bundle_found", F.coalesce("bundle_found", F.lit(False)))


def _source() -> Column:
    return F.struct("light_curve_revision", "persisted_at", "run_id", "effective_epoch_count", "coarse").cast(SOURCE)


def as_of(probes: DataFrame, runs: DataFrame) -> DataFrame:
    """probes (PAIR, light_curve_revision, ...) with ``source``: the latest executed run of their object and bundle whose
    revision is strictly less; among equal revisions the latest persisted, then the greatest run id. The execution mode
    does not matter. One shuffle and one sort of both sides together; strictness comes from the window's range. Runs of
    pairs that are not probed are pruned first."""
    history = runs.where("xgboost_executed").join(probes.select(*PAIR).distinct(), PAIR, "left_semi")
    columns = probes.columns
    both = probes.withColumn("probe", F.lit(True)).unionByName(history.select(*PAIR, "light_curve_revision", _source().alias("own")), allowMissingColumns=True)
    before = Window.partitionBy(*PAIR).orderBy("light_curve_revision").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("source", F.max("own").over(before)).where("probe").select(*columns, "source")


def as_of_stored(probes: DataFrame, history: DataFrame, buckets: int) -> DataFrame:
    """As ``as_of``, where history is a table of executed runs bucketed by PAIR (``sources.tables.save_history``): the probes
    are dealt to its buckets and met by a merge join, so the stored side is neither shuffled nor read twice.

    Each distinct probe meets all runs of its pair before it, which are folded as they come: for a batch of few revisions
    an object. A backlog with many of one object is better served by ``as_of``, which sorts both sides together once."""
    key = [*PAIR, "light_curve_revision"]
    asked = probes.select(*key).repartition(buckets, *PAIR).distinct()
    runs = history.where("xgboost_executed").select(*(F.col(c).alias(f"__{c}") for c in PAIR), _source().alias("source"))
    earlier = [F.col(c) == F.col(f"__{c}") for c in PAIR] + [F.col("source.light_curve_revision") < F.col("light_curve_revision")]
    hits = asked.join(runs.hint("merge"), earlier, "left").groupBy(*key).agg(F.max("source").alias("source"))
    return probes.repartition(buckets, *PAIR).join(hits.hint("merge"), key, "left").select(*probes.columns, "source")


def select_modes(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """tasks (PAIR, light_curve_revision, n, run_id, task_id) of one backlog, valid ones only, with ``mode``, ``source``.

    In revision order a task is executed if it has 20 epochs or fewer, or if nothing compatible came before: whatever
    came before was executed or reused something that was, so the recursion closes and two windows over one sort do.
    Stored runs and tasks of the backlog are sources alike; a task's run id is known beforehand. ``source`` has no
    coarse vector where its run is still to be scored. Two execution modes of one revision are not before each other.
    """
    columns = tasks.columns
    history = runs.where("xgboost_executed").join(tasks.select(*PAIR).distinct(), PAIR, "left_semi").select(*PAIR, "light_curve_revision", _source().alias("own"))
    both = tasks.withColumn("task", F.lit(True)).unionByName(history, allowMissingColumns=True)
    before = Window.partitionBy(*PAIR).orderBy("light_curve_revision").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("prior", F.count("*").over(before) > 0)
    executed = F.col("own").isNotNull() | (F.col("n") <= MAX_CURRENT_EPOCHS) | ~F.col("prior")
    mine = F.struct(F.col("light_curve_revision"), F.lit(None).cast("timestamp").alias("persisted_at"), F.col("run_id"), F.col("n").alias("effective_epoch_count"), F.lit(None).cast("array<float>").alias("coarse"))
    both = both.withColumn("can", F.when(executed, F.coalesce("own", mine.cast(SOURCE))))
    both = both.withColumn("source", F.max("can").over(before)).where("task")
    mode = F.when(F.col("n") <= MAX_CURRENT_EPOCHS, "COMPUTE_CURRENT").when(F.col("source").isNotNull(), "REUSE_PREVIOUS").otherwise("COMPUTE_BOOTSTRAP")
    out = both.withColumn("mode", mode)
    return out.withColumn("source", F.when(F.col("mode") == "REUSE_PREVIOUS", F.col("source"))).select(*columns, "mode", "source")


def source_sound(target_revision: Column, source: Column) -> Column:
    """A reused source has a run id, an earlier positive revision and 3 to 1024 epochs."""
    good = (F.length(source["run_id"]) > 0) & (source["light_curve_revision"] > 0) & (source["light_curve_revision"] < target_revision) & source["effective_epoch_count"].between(MIN_EPOCHS, MAX_EPOCHS)
    return F.coalesce(good, F.lit(False))


def source_columns(tasks: DataFrame) -> DataFrame:
    """Mode to source columns of a run: computed ones are their own source; a reused one names its source's run."""
    reuse = F.col("mode") == "REUSE_PREVIOUS"
    kind = F.when(F.col("mode") == "COMPUTE_CURRENT", 1).when(reuse, 2).otherwise(3)
    return (
        tasks.withColumn("coarse_source_type", kind)
        .withColumn("coarse_source_run_id", F.when(reuse, F.col("source.run_id")))
        .withColumn("coarse_source_light_curve_revision", F.when(reuse, F.col("source.light_curve_revision")).otherwise(F.col("light_curve_revision")))
        .withColumn("coarse_source_epoch_count", F.when(reuse, F.col("source.effective_epoch_count")).otherwise(F.col("n")))
        .withColumn("xgboost_executed", ~reuse)
    )
