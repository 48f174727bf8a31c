"""The whole flow over a backlog: commands to results to runs and current pointers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.functions.identity import run_id
from lumispark.operators import commands as M
from lumispark.operators import light_curves as L
from lumispark.operators import modes, runs, scoring
from lumispark.plans import derive
from lumispark.schemas import COMMAND, EXECUTION_MODES, RUN
from lumispark.sources.messages import decode
from lumispark.sources.shared import materialised

TASK = ["job_id", "run_id", "object_id", "light_curve_revision"]


def prepare(tasks: DataFrame, revisions: DataFrame, epochs: DataFrame, bundles: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, failed) of valid commands. ready has sorted epochs, n, mode and source; failed has ``cause``.

    A bad light curve is named before an unknown bundle, and rows that fail either are gone before modes are selected."""
    checked = modes.resolve_bundles(L.check_revisions(tasks, revisions, epochs), bundles)
    checked = checked.withColumn("cause", F.coalesce("cause", F.when(~F.col("bundle_found"), "BUNDLE_NOT_FOUND")))
    good = checked.where("cause is null").withColumn("run_id", run_id(F.col("job_id"))).withColumn("n", F.col("actual_count"))
    ready = modes.source_columns(modes.select_modes(good.drop("cause", "bundle_found"), stored))
    return ready.join(L.nested(epochs, good), L.KEY), checked.where("cause is not null")


def classify(ready: DataFrame, stored: DataFrame, load: Callable) -> DataFrame:
    """ready rows with coarse, fine, leaf, executed. What computes is scored; what reuses takes its source's coarse vector,
    from a stored run or from this backlog, and is scored for the rest."""
    keep = ["run_id"]
    vectors = L.model_vectors(ready)
    computed = materialised(scoring.score(vectors.where("mode <> 'REUSE_PREVIOUS'"), load, keep))
    own = ready.where("mode <> 'REUSE_PREVIOUS'").join(computed, "run_id")
    source = computed.select(F.col("run_id").alias("coarse_source_run_id"), F.col("coarse").alias("source_coarse"))
    source = source.unionByName(stored.select(F.col("run_id").alias("coarse_source_run_id"), F.col("coarse").alias("source_coarse")))
    again = vectors.where("mode = 'REUSE_PREVIOUS'").join(source, "coarse_source_run_id")
    rest = scoring.score(again, load, keep)
    return own.unionByName(ready.where("mode = 'REUSE_PREVIOUS'").join(rest, "run_id"))


def synthetic_model() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in for a model: probabilities from whole-number weights of object and revision, so that SQL can state them."""

    def model(b: pd.DataFrame) -> pd.DataFrame:
        user = b["object_id"].str[4:].astype(int).to_numpy()
        r = b["light_curve_revision"].to_numpy()
        w = 1 + (user[:, None] * 31 + r[:, None] * 17 + np.arange(7) * 13) % 97
        coarse = (w / w.sum(axis=1, keepdims=True)).astype(np.float32)
        reused = (b["mode"] == "REUSE_PREVIOUS").to_numpy()
        if reused.any():
            coarse[reused] = np.stack(b["source_coarse"][reused].to_list())
        v = 1 + (user[:, None] * 7 + r[:, None] * 5 + np.arange(10) * 11) % 89
        pair = v.reshape(-1, 5, 2)
        fine = (pair / pair.sum(axis=2, keepdims=True)).reshape(-1, 10).astype(np.float32)
        parents = [2, 2, 0, 0, 5, 5, 3, 3, 4, 4]  # places of the fine classes' parents in the coarse order
        leaf = np.concatenate((coarse[:, parents] * fine, coarse[:, [1, 6]]), axis=1)
        return pd.DataFrame({"coarse": list(coarse), "fine": list(fine), "leaf": list(leaf), "executed": ~reused})

    return model


def derived_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialised(derive.commands(spark, sf_dir))
    return rows.select("job_id", "object_id", "candidate_revision", "light_curve_revision", "declared_eligible_epoch_count", "model_bundle_version", "execution_mode", F.col("created_at").alias("completed_at"))


def derived_ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    epochs = derive.epochs(spark, sf_dir)
    bundles = spark.createDataFrame([(derive.BUNDLE,)], "model_bundle_version string")
    return prepare(derived_tasks(spark, sf_dir), derive.revisions(epochs), epochs, bundles, no_runs(spark))


def no_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([*RUN, T.StructField("persisted_at", T.TimestampType())]))


def derived_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, _ = derived_ready(spark, sf_dir)
    ready = materialised(ready)
    # the synthetic model needs the object's name beside the vectors
    return classify(ready, no_runs(spark), synthetic_model)


def derived_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their arrival (partition, offset)."""
    built = materialised(runs.build_runs(derived_scored(spark, sf_dir)))
    user = derive.user_of(F.col("object_id"))
    # in each object the revisions arrive out of order: 2, 4, 1, 3, 5
    place = F.get(F.array(*map(F.lit, (2, 0, 3, 1, 4))), (F.col("light_curve_revision") - 1).cast("int"))
    return built.withColumn("partition", (user % 3).cast("int")).withColumn("offset", (user * 10 + place).cast("long"))


def validated_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validate_commands(decode(derive.command_envelopes(spark, sf_dir), COMMAND), derive.COMMANDS)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming results: every run, again those of even users (replays, later), SHADOW copies apart, and for users divisible
    by 7 one of the same job with another run id."""
    rows = derived_runs(spark, sf_dir)
    user = derive.user_of(F.col("object_id"))
    replay = rows.where(user % 2 == 0).withColumn("offset", F.col("offset") + 5_000_000)
    clash = rows.where(user % 7 == 0).withColumn("run_id", F.concat(F.lit("ffffffff"), F.substring("run_id", 9, 28))).withColumn("offset", F.col("offset") + 9_000_000)
    shadow = rows.where(user % 11 == 0).withColumn("execution_mode", F.lit(EXECUTION_MODES["SHADOW"])).withColumn("job_id", F.concat(F.lit("eeeeeeee"), F.substring("job_id", 9, 28))).withColumn("run_id", F.concat(F.lit("eeeeeeee"), F.substring("run_id", 9, 28))).withColumn("offset", F.col("offset") + 7_000_000)
    return rows.unionByName(replay).unionByName(clash).unionByName(shadow)
