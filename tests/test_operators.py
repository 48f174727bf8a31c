"""Operators on small tables: ladders, light curves, modes, saving."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumispark.functions.identity import job_id
from lumispark.operators import candidates as C
from lumispark.operators import commands as M
from lumispark.operators import light_curves as L
from lumispark.operators import modes, operations, runs
from lumispark.plans.flow import no_runs
from lumispark.schemas import CANDIDATE, COMMAND, ENVELOPE, RUN
from lumispark.sources.files import parse_light_curve_files, parse_revision_documents
from lumispark.sources.messages import decode

GOOD = {"event_id": "e", "event_type": 1, "object_id": "o", "candidate_revision": 1, "light_curve_revision": 2, "eligible_epoch_count": 3, "occurred_at": "2024-01-01T00:00:00Z", "producer": "p", "upstream_pipeline_version": "v"}


def envelope(spark, rows):
    import json

    def value(v):
        return v if isinstance(v, (bytes, type(None))) else json.dumps(v).encode()

    data = [(k.encode() if k is not None else None, bytearray(value(v)) if value(v) is not None else None, t, 0, i, None, None) for i, (t, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, ENVELOPE)


CANDIDATE_CASES = [
    (("c", "o", GOOD), None, None),
    (("c", "o", GOOD | {"event_type": 2}), None, None),
    (("x", "o", GOOD), "CANDIDATE_TOPIC_UNEXPECTED", "topic"),
    (("c", "", GOOD), "CANDIDATE_KEY_MISSING", "key"),
    (("c", None, GOOD), "CANDIDATE_KEY_MISSING", "key"),
    (("c", "o", b""), "CANDIDATE_PROTO_MALFORMED", "value"),
    (("c", "o", b"{no"), "CANDIDATE_PROTO_MALFORMED", "value"),
    (("c", "o", GOOD | {"event_type": 3}), "CANDIDATE_EVENT_TYPE_UNSUPPORTED", "event_type"),
    (("c", "o", GOOD | {"event_id": " e"}), "CANDIDATE_EVENT_INVALID", "event_id"),
    (("c", "o", GOOD | {"object_id": ""}), "CANDIDATE_EVENT_INVALID", "object_id"),
    (("c", "o", GOOD | {"candidate_revision": 0}), "CANDIDATE_EVENT_INVALID", "candidate_revision"),
    (("c", "o", GOOD | {"light_curve_revision": -1}), "CANDIDATE_EVENT_INVALID", "light_curve_revision"),
    (("c", "o", GOOD | {"eligible_epoch_count": 2}), "CANDIDATE_EVENT_INVALID", "eligible_epoch_count"),
    (("c", "other", GOOD), "CANDIDATE_KEY_MISMATCH", "key"),
    (("c", "o", {k: v for k, v in GOOD.items() if k != "occurred_at"}), "CANDIDATE_EVENT_INVALID", "occurred_at"),
    (("c", "o", GOOD | {"occurred_at": "0001-01-01T00:00:00Z"}), "CANDIDATE_EVENT_INVALID", "occurred_at"),
    (("c", "o", GOOD | {"producer": "p "}), "CANDIDATE_EVENT_INVALID", "producer"),
    (("c", "o", GOOD | {"upstream_pipeline_version": ""}), "CANDIDATE_EVENT_INVALID", "upstream_pipeline_version"),
]


def test_candidate_ladder_and_dead_letters(spark):
    rows = C.validate_candidates(decode(envelope(spark, [c[0] for c in CANDIDATE_CASES]), CANDIDATE), "c")
    got = {r["offset"]: tuple(r["error"]) if r["error"] else (None, None) for r in rows.select("offset", "error").collect()}
    assert got == {i: (code, field) for i, (_, code, field) in enumerate(CANDIDATE_CASES)}
    letters = C.candidate_dead_letters(rows, "dlq").collect()
    assert len(letters) == len(CANDIDATE_CASES) - 2 and all(len(r["headers"]) == 4 for r in letters)
    made = C.commands(rows, "b", "cmd").collect()
    assert len(made) == 2 and {r["object_id"] for r in made} == {"o"} and made[0]["trace"] is None


def test_command_ladder(spark):
    job = spark.range(1).select(job_id(F.lit("o"), F.lit(2), F.lit("b"), F.lit(1)).alias("j")).first()["j"]
    good = {"job_id": job, "object_id": "o", "candidate_revision": 1, "light_curve_revision": 2, "declared_eligible_epoch_count": 3, "model_bundle_version": "b", "execution_mode": 1, "priority": 1, "created_at": "2024-01-01T00:00:00Z"}
    cases = [
        (good, None),
        (good | {"execution_mode": 9}, "COMMAND_EXECUTION_MODE_UNSUPPORTED"),
        (good | {"priority": 2}, "COMMAND_PRIORITY_UNSUPPORTED"),
        (good | {"deadline_at": "2024-01-01T00:00:00Z"}, "COMMAND_DEADLINE_UNSUPPORTED"),
        (good | {"job_id": "x"}, "COMMAND_JOB_ID_MISMATCH"),
        (good | {"declared_eligible_epoch_count": 2}, "COMMAND_FIELD_INVALID"),
        (good | {"model_bundle_version": " b"}, "COMMAND_FIELD_INVALID"),
    ]
    rows = M.validate_commands(decode(envelope(spark, [("c", "o", c) for c, _ in cases]), COMMAND), "c").select("offset", "error").collect()
    assert {r["offset"]: r["error"]["code"] if r["error"] else None for r in rows} == {i: code for i, (_, code) in enumerate(cases)}


def curves(spark, named):
    rows = [(o, 1, i, *map(float, e)) for o, es in named.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "object_id string, light_curve_revision long, epoch_index long, observation_time double, magnitude double, magnitude_error double").withColumn("magnitude", F.col("magnitude").cast("float")).withColumn("magnitude_error", F.col("magnitude_error").cast("float"))


def test_light_curve_checks(spark):
    nan, inf = float("nan"), float("inf")
    base = [(59003.5, 16.1, 0.01), (59001.5, 16.2, 0.02), (59002.5, 16.3, 0.03)]
    named = {
        "ok": base,
        "few": base[:2],
        "many": [(i, 1, 1) for i in range(1025)],
        "most": [(i, 1, 1) for i in range(1024)],
        "nan_time": [*base, (nan, 1, 1)],
        "inf_mag": [*base, (1, inf, 1)],
        "zero_err": [*base, (1, 1, 0)],
        "neg_err": [*base, (1, 1, -1)],
        "first_bad": [(1, nan, 0), (nan, 1, 1), (2, 1, 1)],
        "twice": [*base, base[0]],
        "zeros": [(0.0, 1, 1), (-0.0, 1, 1), (1.0, 1, 1)],
    }
    flat = curves(spark, named)
    meta = flat.groupBy(*L.KEY).agg(F.count("*").alias("eligible_epoch_count"))
    asked = meta.withColumn("declared_eligible_epoch_count", F.col("eligible_epoch_count") + (F.col("object_id") == "none").cast("int"))
    asked = asked.unionByName(spark.createDataFrame([("gone", 1, 3, 3), ("ok", 1, 3, 4)], asked.schema))
    got = {(r["object_id"], r["declared_eligible_epoch_count"]): r["cause"] for r in L.check_revisions(asked, meta, flat).collect()}
    want = dict.fromkeys(named) | {"few": "TOO_FEW_EPOCHS", "many": "TOO_MANY_EPOCHS", "nan_time": "BAD_TIME", "inf_mag": "BAD_MAGNITUDE", "zero_err": "BAD_MAGNITUDE_ERROR", "neg_err": "BAD_MAGNITUDE_ERROR", "first_bad": "BAD_MAGNITUDE", "twice": "DUPLICATE_TIME", "zeros": "DUPLICATE_TIME"}
    assert {k[0]: v for k, v in got.items() if k != ("ok", 4) and k[0] != "gone"} == want
    assert got[("ok", 4)] == "EPOCH_COUNT_MISMATCH" and got[("gone", 3)] == "REVISION_NOT_FOUND"


@pytest.mark.parametrize("seed", range(3))
def test_input_order_does_not_matter(spark, seed):
    es = [(63001 + i, 15 + i / 10, 0.01) for i in range(5)]
    random.Random(seed).shuffle(es)
    flat = curves(spark, {"o": es})
    row = L.model_vectors(L.nested(flat, flat)).first()
    assert row["times"] == [63001.0 + i for i in range(5)] and row["normalised_times"] == [1.0, 2.0, 3.0, 4.0, 5.0]


def tasks(spark, rows):
    return spark.createDataFrame([(o, "b", r, n, f"run-{o}-{r}") for o, r, n in rows], "object_id string, model_bundle_version string, light_curve_revision long, n long, run_id string")


def test_modes_at_the_boundary_and_in_one_pass(spark):
    rows = [("a", 1, 20), ("a", 2, 21), ("a", 3, 25), ("b", 5, 21), ("b", 6, 22), ("b", 7, 10), ("b", 8, 30)]
    got = {(r["object_id"], r["light_curve_revision"]): (r["mode"], r["source"]["light_curve_revision"] if r["source"] else None) for r in modes.select_modes(tasks(spark, rows), no_runs(spark)).collect()}
    assert got == {("a", 1): ("COMPUTE_CURRENT", None), ("a", 2): ("REUSE_PREVIOUS", 1), ("a", 3): ("REUSE_PREVIOUS", 1), ("b", 5): ("COMPUTE_BOOTSTRAP", None), ("b", 6): ("REUSE_PREVIOUS", 5), ("b", 7): ("COMPUTE_CURRENT", None), ("b", 8): ("REUSE_PREVIOUS", 7)}


def test_modes_agree_with_one_by_one(spark):
    rng = random.Random(5)
    rows = [(f"o{o}", r, rng.choice((5, 20, 21, 40))) for o in range(40) for r in sorted(rng.sample(range(1, 12), 6))]
    want = {}
    done: dict[str, int] = {}
    for o, r, n in rows:
        if n <= 20:
            want[(o, r)], done[o] = ("COMPUTE_CURRENT", None), r
        elif o in done:
            want[(o, r)] = ("REUSE_PREVIOUS", done[o])
        else:
            want[(o, r)], done[o] = ("COMPUTE_BOOTSTRAP", None), r
    rng.shuffle(rows)
    got = {(r["object_id"], r["light_curve_revision"]): (r["mode"], r["source"]["light_curve_revision"] if r["source"] else None) for r in modes.select_modes(tasks(spark, rows), no_runs(spark)).collect()}
    assert got == want


def run_row(o, rev, mode=1, bundle="default", run=None, job=None, executed=True, at=0):
    run, job = run or f"run-{o}-{rev}-{mode}-{bundle}", job or f"job-{o}-{rev}-{mode}-{bundle}"
    values = dict(run_id=run, job_id=job, object_id=o, candidate_revision=1, light_curve_revision=rev, effective_epoch_count=10, execution_mode=mode, coarse_source_type=1, coarse_source_run_id=None, coarse_source_light_curve_revision=rev, coarse_source_epoch_count=10, xgboost_executed=executed, model_bundle_version=bundle, coarse=None, fine=None, leaf=None, predicted_coarse_class=10, predicted_leaf_class=30, completed_at=None)
    return (*(values[f.name] for f in RUN), 0, at)


def frame(spark, rows):
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([*RUN, T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())]))


SCENARIO = [
    (run_row("C", 10), True, True),
    (run_row("C", 10), False, False),
    (run_row("C", 10, run="other"), None, False),
    (run_row("C", 12), True, True),
    (run_row("C", 11), True, False),
    (run_row("C", 12, bundle="bundle-v2"), True, False),
    (run_row("M", 20, mode=2), True, False),
    (run_row("M", 21, mode=3), True, False),
    (run_row("M", 22), True, True),
    (run_row("M", 23, mode=2), True, False),
    (run_row("M", 24, mode=3), True, False),
]


def test_saving_in_one_batch_is_saving_one_by_one(spark):
    rows = frame(spark, [(*r[:-1], i) for i, (r, _, _) in enumerate(SCENARIO)])
    none = frame(spark, [])
    got = {r["offset"]: (r["outcome"], r["advanced"]) for r in runs.save_outcomes(rows, none, none).collect()}
    names = {True: "INSERTED", False: "NO_OP", None: "RESULT_REPOSITORY_CONFLICT"}
    assert got == {i: (names[ins], adv) for i, (_, ins, adv) in enumerate(SCENARIO)}
    kept = runs.save_outcomes(rows, none, none).where("inserted").select(*rows.columns)
    pointers = runs.current_pointers(kept)
    assert {(r["object_id"], r["run_id"]) for r in pointers.collect()} == {("C", "run-C-12-1-default"), ("M", "run-M-22-1-default")}
    # the same batch again changes nothing
    again = runs.save_outcomes(rows, kept, pointers).collect()
    assert not any(r["inserted"] or r["advanced"] for r in again)


def test_as_of_is_strict_and_ignores_modes(spark):
    stored = frame(spark, [run_row("o", 30, bundle="base"), run_row("o", 31, mode=2, bundle="base"), run_row("o", 32, bundle="base", executed=False), run_row("o", 33, bundle="other")]).withColumn("persisted_at", F.lit(None).cast("timestamp"))
    probes = spark.createDataFrame([("o", "base", 34), ("o", "base", 31), ("o", "base", 30), ("o", "unknown", 34)], "object_id string, model_bundle_version string, light_curve_revision long")
    got = {(r["model_bundle_version"], r["light_curve_revision"]): r["source"]["light_curve_revision"] if r["source"] else None for r in modes.as_of(probes, stored).collect()}
    assert got == {("base", 34): 31, ("base", 31): 30, ("base", 30): None, ("unknown", 34): None}


def test_files(spark):
    files = spark.createDataFrame(
        [
            ("/d/object-b.csv", "MJD,Mag,Mag_err\n3, 1, .1\n1,2,.1\n\n2,3,.1"),
            ("/d/object-a.txt", "# note\ntime mag error\n1 2 3\n2 2 3\n"),
            ("/d/bad.csv", "1,2\n"),
            ("/d/word.csv", "1,2,x\n"),
            ("/d/empty.csv", "# only\n"),
            ("/d/same.csv", "1,2,3"),
            ("/e/same.TXT", "1 2 3"),
        ],
        "path string, value string",
    )
    good, errors = parse_light_curve_files(files)
    assert {(r["object_id"], r["n"]) for r in good.groupBy("object_id").agg(F.count("*").alias("n")).collect()} == {("object-b", 3), ("object-a", 2)}
    assert {(r["object_id"], r["reason"]) for r in errors.collect()} == {("bad", "columns"), ("word", "number"), ("empty", "empty"), ("same", "duplicate_name")}


def test_documents(spark):
    e = '{"observation_time":1,"magnitude":2,"magnitude_error":3}'
    docs = [f'{{"object_id":"o","light_curve_revision":1,"eligible_epoch_count":1,"epochs":[{e}],"more":1}}', '{"object_id":"o","light_curve_revision":1,"eligible_epoch_count":1,"epochs":[{"observation_time":1}]}', '{"object_id":"o"}', "no"]
    got = parse_revision_documents(spark.createDataFrame([(d,) for d in docs], "document string")).collect()
    assert [r["consistent"] for r in got] == [True, False, False, False]


def test_quantile_and_alerts(spark):
    rows = spark.createDataFrame([("a", 1.0, 50), ("a", 2.0, 90), ("a", float("inf"), 100), ("b", 1.0, 0), ("b", float("inf"), 0)], "k string, le double, cumulative long")
    got = {r["k"]: r["quantile"] for r in operations.bucket_quantile(rows, ["k"], 0.7).collect()}
    assert got == {"a": 1.5, "b": None}
    inc = spark.createDataFrame([("s", i, v) for i, v in enumerate((5.0, 8.0, 3.0, 4.0))], "s string, ts long, value double")
    assert [r["increase"] for r in operations.increases(inc, ["s"]).orderBy("ts").collect()] == [0.0, 3.0, 3.0, 1.0]


def test_object_ids_of_seven_digits_stay_apart(spark):
    from lumispark.plans import derive

    users = [0, 7, 100_000, 999_999, 1_000_000, 1_000_001, 12_345_678]
    rows = spark.createDataFrame([(u,) for u in users], "user_id int").withColumn("object_id", derive.object_of(F.col("user_id")))
    got = {r["user_id"]: (r["object_id"], r["back"]) for r in rows.withColumn("back", derive.user_of(F.col("object_id"))).collect()}
    assert got == {u: (f"OBJ-{u:06d}", u) for u in users}
