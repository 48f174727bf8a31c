"""Recorded outputs of the model: fusion, checks and classes must agree with them bit for bit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumispark.functions import vectors as V
from lumispark.operators import scoring

# Coarse, fine and leaf probabilities as recorded for one light curve of 20 epochs, computed, and for one of 21,
# bootstrapped and then reused.
CURRENT = (
    [4.060041760567401e-07, 0.9990556836128235, 7.259970402628824e-07, 0.0009179043699987233, 1.7375126844854094e-05, 7.802904292475432e-06, 6.877440483776809e-08],
    [0.6092000007629395, 0.39079999923706055, 0.7866122722625732, 0.21338766813278198, 0.3463256359100342, 0.6536743640899658, 0.876477837562561, 0.12352217733860016, 0.16036716103553772, 0.8396328687667847],
    [4.4227741113900265e-07, 2.837196291238797e-07, 3.193678708157677e-07, 8.663628392469036e-08, 2.7023456823371816e-06, 5.1005586101382505e-06, 0.0008045228314585984, 0.00011338154581608251, 2.786399818432983e-06, 1.4588727935915813e-05, 0.9990556836128235, 6.877440483776809e-08],
)
OLDER = (
    [7.129470418476558e-07, 0.9993150234222412, 4.2646459519346536e-07, 0.0006723808473907411, 6.470346761489054e-06, 4.851902303926181e-06, 9.197208328259876e-08],
    [0.6159680485725403, 0.38403189182281494, 0.7939228415489197, 0.20607709884643555, 0.36346012353897095, 0.636539876461029, 0.8997647762298584, 0.10023517906665802, 0.16890348494052887, 0.8310965299606323],
    [2.626885589052108e-07, 1.6377600786654511e-07, 5.660249371430837e-07, 1.4692206207200798e-07, 1.7634730511417729e-06, 3.088429366471246e-06, 0.0006049845833331347, 6.739621312590316e-05, 1.0928640676866053e-06, 5.377482921176124e-06, 0.9993150234222412, 9.197208328259876e-08],
)
SCHEMA = "run_id string, mode string, executed boolean, coarse array<float>, fine array<float>, leaf array<float>"


@pytest.fixture(scope="module")
def recorded(spark):
    rows = [("a", "COMPUTE_CURRENT", True, *CURRENT), ("b", "COMPUTE_BOOTSTRAP", True, *OLDER), ("c", "REUSE_PREVIOUS", False, *OLDER)]
    return spark.createDataFrame(rows, SCHEMA)


def test_recorded_leaves_are_the_fusion_bit_for_bit(recorded):
    assert recorded.where(V.fuse(F.col("coarse"), F.col("fine")) == F.col("leaf")).count() == 3


def test_recorded_outputs_are_sound_and_named(recorded):
    rows = scoring.predicted(recorded.withColumn("error", scoring.output_error(F.col("mode")))).collect()
    assert {(r["error"], r["predicted_coarse_class"], r["predicted_leaf_class"]) for r in rows} == {(None, 30, 30)}


def test_recorded_outputs_are_accepted_against_themselves_and_not_each_other(recorded):
    same = scoring.acceptance(recorded, recorded).collect()
    assert all(r["coarse_close"] and r["fine_close"] and r["leaf_close"] for r in same)
    swapped = recorded.withColumn("run_id", F.translate("run_id", "ab", "ba"))
    assert {r["run_id"]: r["coarse_close"] for r in scoring.acceptance(recorded, swapped).collect()} == {"a": False, "b": False, "c": True}


def test_reused_coarse_vector_comes_back_bit_for_bit(spark, recorded):
    rows = recorded.where("mode = 'REUSE_PREVIOUS'").select("run_id", "mode", F.struct(F.array(*(F.lit(x).cast("float") for x in OLDER[0])).alias("coarse")).alias("source"), F.lit(1.0).alias("x"))
    never = lambda: lambda b: b.assign(coarse=[[1.0] + [0.0] * 6] * len(b))
    fine = lambda: lambda b: b.assign(fine=[OLDER[1]] * len(b))
    got = scoring.score_split(rows, never, fine, ["run_id"]).first()
    want = recorded.where("run_id = 'c'").first()
    assert (got["coarse"], got["leaf"], got["executed"]) == (want["coarse"], want["leaf"], False)
