"""Scalar functions: golden ids, string rule, vectors and codes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumispark.functions import status as S
from lumispark.functions import vectors as V
from lumispark.functions.identity import canonical_uuid, good_string, job_id, run_id
from lumispark.schemas import COARSE, LEAF


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_golden_ids(spark):
    r = one(spark, job_id(F.lit("OBJ-0001"), F.lit(21), F.lit("bundle-2026-07-001"), F.lit(1)).alias("j"))
    assert r["j"] == "2f199935-6d68-5868-944c-9675f194ac09"
    assert one(spark, run_id(F.lit(r["j"])).alias("r"))["r"] == "f3042c4a-04ba-517f-b57e-92c3022e7af7"


@pytest.mark.parametrize("change", [("OBJ-0002", 21, "b", 1), ("OBJ-0001", 22, "b", 1), ("OBJ-0001", 21, "c", 1), ("OBJ-0001", 21, "b", 2)])
def test_each_input_counts(spark, change):
    ids = [job_id(*map(F.lit, x)).alias(f"c{i}") for i, x in enumerate((("OBJ-0001", 21, "b", 1), change))]
    a, b = one(spark, *ids)
    assert a != b and len(a) == 36


@pytest.mark.parametrize("bad", [("", 1, "b", 1), (" x", 1, "b", 1), ("x ", 1, "b", 1), ("x\0y", 1, "b", 1), ("x", 0, "b", 1), ("x", 1, "b", 4), ("x", 1, "b\n", 1)])
def test_bad_identity_has_no_id(spark, bad):
    assert one(spark, job_id(*map(F.lit, bad)).alias("j"))["j"] is None


def test_strings_and_uuids(spark):
    cases = {"a": True, "a b": True, "": False, " a": False, "a\t": False, "a\0": False}
    assert [one(spark, good_string(F.lit(s)).alias("g"))["g"] for s in cases] == list(cases.values())
    assert not one(spark, good_string(F.lit(None).cast("string")).alias("g"))["g"]
    uuids = {"f3042c4a-04ba-517f-b57e-92c3022e7af7": True, "F3042c4a-04ba-517f-b57e-92c3022e7af7": False, "00000000-0000-0000-0000-000000000000": False, "x": False}
    assert [one(spark, canonical_uuid(F.lit(s)).alias("g"))["g"] for s in uuids] == list(uuids.values())


def floats(xs):
    return F.array(*(F.lit(x).cast("float") for x in xs))


def test_first_maximum_and_classes(spark):
    nan = float("nan")
    rows = {(0.4, 0.4, 0.1): 1, (0.1, 0.5, 0.5): 2, (0.1, nan, 0.3): 3, (nan, 0.9): 1}
    assert [one(spark, V.first_maximum(floats(k)).alias("m"))["m"] for k in rows] == list(rows.values())
    coarse = [0.4, 0.4, 0.1, 0.05, 0.02, 0.02, 0.01]
    leaf = [0.3, 0.3] + [0.04] * 10
    r = one(spark, V.class_of(floats(coarse), COARSE).alias("c"), V.class_of(floats(leaf), LEAF).alias("l"))
    assert (r["c"], r["l"]) == (50, 6001)


def test_fusion_copies_two_and_multiplies_ten(spark):
    coarse, fine = [0.1, 0.2, 0.3, 0.1, 0.1, 0.15, 0.05], [0.25, 0.75, 0.5, 0.5, 0.9, 0.1, 0.6, 0.4, 0.3, 0.7]
    r = one(spark, V.fuse(floats(coarse), floats(fine)).alias("l"), V.contract_sums(floats(coarse), floats(fine), V.fuse(floats(coarse), floats(fine))).alias("ok"))
    assert r["ok"]
    want = [0.075, 0.225, 0.05, 0.05, 0.135, 0.015, 0.06, 0.04, 0.03, 0.07, 0.2, 0.05]
    assert r["l"] == pytest.approx(want, abs=1e-7)


def test_probabilities_lengths_and_padding(spark):
    nan, inf = float("nan"), float("inf")
    r = one(spark, *(V.probabilities_fine(floats(x), 2).alias(f"c{i}") for i, x in enumerate(([0.0, 1.0], [0.5], [nan, 0.1], [inf, 0.1], [-0.1, 1.0]))))
    assert list(r) == [True, False, False, False, False]
    buckets = one(spark, *(V.length_bucket(F.lit(n)).alias(f"b{n}") for n in (3, 32, 33, 1024, 1025)))
    assert list(buckets) == [32, 32, 64, 1024, None]
    r = one(spark, V.padded(floats([1, 2]), F.lit(4)).alias("p"), V.mask(F.lit(2), F.lit(4)).alias("m"))
    assert r["p"] == [1, 2, 0, 0] and r["m"] == [1, 1, 0, 0]


def test_numbers(spark):
    cases = {"1.5": 1.5, "1e39": None, "1d": None, "1f": None, "": None, "-.5": -0.5, "NaN": "nan", "+Inf": float("inf"), "1e": None}
    for text, want in cases.items():
        got = one(spark, V.parse_number(F.lit(text), "float").alias("x"))["x"]
        assert (got != got) if want == "nan" else got == want, text


@pytest.mark.parametrize(
    ("cause", "status", "operation", "want"),
    [
        ("CANCELLED", None, "classify", ("CANCELLED", "WORKER_CANCELLED")),
        ("REVISION_NOT_FOUND", None, "prepare-input", ("PERMANENT", "LIGHT_CURVE_NOT_FOUND")),
        ("REVISION_NOT_READY", None, "prepare-input", ("RETRYABLE", "LIGHT_CURVE_NOT_READY")),
        ("DUPLICATE_TIME", None, "prepare-input", ("PERMANENT", "LIGHT_CURVE_INVALID")),
        (None, 429, "classify", ("RETRYABLE", "TRITON_UNAVAILABLE")),
        (None, 503, "classify", ("RETRYABLE", "TRITON_UNAVAILABLE")),
        (None, 404, "classify", ("PERMANENT", "TRITON_REQUEST_REJECTED")),
        (None, None, "publish-result", ("RETRYABLE", "RESULT_PUBLISH_FAILED")),
        (None, None, "build-run", ("PERMANENT", "WORKER_INTERNAL_INVALID")),
    ],
)
def test_failures(spark, cause, status, operation, want):
    f = S.failure(F.lit(cause).cast("string"), F.lit(operation), F.lit(status).cast("int"))
    assert tuple(one(spark, f.alias("f"))["f"]) == want
