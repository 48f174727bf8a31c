"""Scoring prepared light curves with a pluggable vectorised model, and checks of what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.functions import vectors as V
from lumispark.schemas import COARSE, LEAF

OUTPUT = T.StructType([T.StructField(c, T.ArrayType(T.FloatType())) for c in ("coarse", "fine", "leaf")] + [T.StructField("executed", T.BooleanType())])


def score(prepared: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keep: list[str], by_length: bool = True) -> DataFrame:
    """keep + coarse, fine, leaf, executed, from a model that ``load`` makes once in each task.

    The model takes a batch with ``keep`` and the vector columns and returns coarse, fine, leaf and executed. Rows are
    sorted by length bucket within a task, so that a batch has little padding; nothing is shuffled for it."""
    schema = T.StructType([*prepared.select(*keep).schema, *OUTPUT])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = model(batch)
            yield pd.concat([batch[keep].reset_index(drop=True), out[OUTPUT.names].reset_index(drop=True)], axis=1)

    rows = prepared.sortWithinPartitions("length_bucket") if by_length and "length_bucket" in prepared.columns else prepared
    return rows.mapInPandas(run, schema)


def score_split(prepared: DataFrame, load_coarse, load_fine, keep: list[str]) -> DataFrame:
    """Two models: coarse runs only where the mode computes; a reused row keeps its 7-vector bit for bit. Then both fuse."""
    compute = F.col("mode") != "REUSE_PREVIOUS"
    wide = T.ArrayType(T.FloatType())

    def runner(load, column):
        def run(batches):
            model = load()
            for b in batches:
                yield b[keep].assign(**{column: model(b)[column].to_list()})

        return run

    schema = prepared.select(*keep).schema
    coarse = prepared.where(compute).mapInPandas(runner(load_coarse, "coarse"), T.StructType([*schema, T.StructField("coarse", wide)]))
    coarse = coarse.unionByName(prepared.where(~compute).select(*keep, F.col("source.coarse").alias("coarse")))
    fine = prepared.mapInPandas(runner(load_fine, "fine"), T.StructType([*schema, T.StructField("fine", wide)]))
    both = coarse.join(fine, keep).join(prepared.select(*keep, compute.alias("executed")), keep)
    return both.withColumn("leaf", V.fuse(F.col("coarse"), F.col("fine")))


def ad_hoc_mode(n: Column) -> Column:
    """Without history: 20 epochs or fewer compute now, more bootstrap, nothing is reused."""
    return F.when(n <= 20, "COMPUTE_CURRENT").otherwise("COMPUTE_BOOTSTRAP")


def output_error(mode: Column) -> Column:
    """What is wrong with a model's output, null if nothing is: vectors, the executed flag, sums."""
    fine = V.probabilities_fine(F.col("coarse"), 7) & V.probabilities_fine(F.col("fine"), 10) & V.probabilities_fine(F.col("leaf"), 12)
    return (
        F.when(~fine, "PROBABILITIES")
        .when(F.coalesce(F.col("executed") != (mode != "REUSE_PREVIOUS"), F.lit(True)), "EXECUTED_FLAG")
        .when(~V.contract_sums(F.col("coarse"), F.col("fine"), F.col("leaf")), "SUMS")
    )


def predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_coarse_class", V.class_of(F.col("coarse"), COARSE)).withColumn("predicted_leaf_class", V.class_of(F.col("leaf"), LEAF))


def acceptance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of two models side by side, and whether b is within the tolerances of a: coarse 1e-5 / 1e-6, others 2e-3 / 2e-6."""
    mine = a.select("run_id", *(F.col(c).alias(f"{c}_a") for c in ("coarse", "fine", "leaf")))
    both = mine.join(b.select("run_id", "coarse", "fine", "leaf"), "run_id")
    tolerance = {"coarse": (1e-5, 1e-6), "fine": (2e-3, 2e-6), "leaf": (2e-3, 2e-6)}
    checks = [V.close(F.col(c), F.col(f"{c}_a"), *t).alias(f"{c}_close") for c, t in tolerance.items()]
    return both.select("run_id", *checks)


def labelled(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Long table of labelled probabilities in falling order: run_id, vector, rank, label, probability."""
    parts = []
    for vector, labels in names.items():
        rows = df.select("run_id", F.lit(vector).alias("vector"), F.posexplode(V.ranked(F.col(vector), labels)).alias("rank", "e"))
        parts.append(rows.select("run_id", "vector", (F.col("rank") + 1).alias("rank"), "e.label", "e.probability"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
