"""The work of a command stream: each batch's commands to runs and results, with what earlier batches have stored."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.functions import status as S
from lumispark.operators import runs as R
from lumispark.operators.modes import PAIR
from lumispark.plans.flow import classify, prepare
from lumispark.schemas import result_schema
from lumispark.sources.messages import encode
from lumispark.sources.shared import materialised
from lumispark.sources.tables import RunStore

FIELDS = ("job_id", "object_id", "candidate_revision", "light_curve_revision", "declared_eligible_epoch_count", "model_bundle_version", "execution_mode")
ENVELOPE = ("key", "value", "topic", "partition", "offset", "timestamp", "headers")


def classifying(
    store: RunStore, revisions: DataFrame, epochs: DataFrame, bundles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], topic: str
) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """What ``command_stream`` takes as its ``process``: valid commands to (results, failed).

    Results are envelopes of ``topic`` with the command's key, partition, offset and headers, as ``result_stream`` reads
    them. A command of over 20 epochs reuses the coarse vector of the latest executed run of its object and bundle before
    its revision: a run of its own batch, or one that the store held when the batch began. Of the store's runs, those of
    the batch's objects are read, by bucket and object. Commands that have no sound light curve, name no known bundle or
    give no consistent run fail, by the step that they failed at; each command gives one result or one failure.
    A command's own time is its run's, so a batch that runs again gives the same bytes."""

    def process(good: DataFrame) -> tuple[DataFrame, DataFrame]:
        tasks = good.select(*ENVELOPE, *(F.col(f"m.{c}").alias(c) for c in FIELDS), F.col("m.created_at").alias("completed_at"), F.col("m.trace").alias("trace"))
        tasks = materialised(tasks)  # four steps below read them
        commit = store.commit()
        stored = store.runs_of(tasks.select("object_id"), commit).where("xgboost_executed").join(tasks.select(*PAIR).distinct(), PAIR, "left_semi")
        stored = materialised(stored.drop("partition", "offset", "stream", "batch", "bucket"))
        ready, unready = prepare(tasks, revisions, epochs, bundles, stored)
        scored = materialised(classify(materialised(ready), stored, load))
        lost = R.unbuilt(scored).withColumn("operation", F.lit("build-result"))
        failed = unready.withColumn("operation", F.lit("prepare-input"))
        failed = failed.withColumn("failure", S.failure(F.col("cause"), F.col("operation")))
        columns = [*ENVELOPE, "failure", "operation"]
        # what rides along is named apart: a run has none of an envelope's columns
        built = R.build_runs(scored, keep=("key", "partition", "offset", "headers", "trace"))
        fields = [f.name for f in result_schema()]
        results = R.to_result(built).select("key", encode(F.struct(*fields)).alias("value"), F.lit(topic).alias("topic"), "partition", "offset", F.col("completed_at").alias("timestamp"), "headers")
        return results, failed.select(*columns).unionByName(lost.select(*columns))

    return process
