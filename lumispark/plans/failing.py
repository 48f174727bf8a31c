"""Queries in which every rung of a ladder, every constraint and every check has rows that fail it.

Row k of a cycle is spoilt in the k-th way; rows of k = 0 are sound. A way is what columns become (as SQL expressions of the
sound row), and what the outcome must be called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions.identity import good_string
from lumispark.operators import runs, scoring
from lumispark.plans import derive, flow
from lumispark.schemas import result_schema
from lumispark.sources.messages import decode, encode

RESULT = result_schema()
SOME_UUID = "'00000000-0000-5000-8000-000000000001'"
BAD = "RESULT_FIELD_INVALID"


def _null(c: str) -> str:
    return f"CAST(NULL AS {RESULT[c].dataType.simpleString()})"


RESULT_WAYS = [
    ({"topic": "'elsewhere'"}, ("RESULT_TOPIC_UNEXPECTED", "topic")),
    ({"key": "''"}, (BAD, "key")),
    ({"text": "'{bad'"}, ("RESULT_MESSAGE_MALFORMED", "value")),
    ({"text": "''"}, ("RESULT_MESSAGE_MALFORMED", "value")),
    ({"versions": _null("versions")}, (BAD, "versions")),
    ({"coarse": _null("coarse")}, (BAD, "coarse_probabilities")),
    ({"fine": _null("fine")}, (BAD, "fine_conditional_probabilities")),
    ({"leaf": _null("leaf")}, (BAD, "leaf_probabilities")),
    ({"completed_at": _null("completed_at")}, (BAD, "completed_at")),
    ({"coarse_source_run_id": "'0A8B2C3D-0000-5000-8000-000000000001'"}, (BAD, "coarse_source_run_id")),
    ({"coarse_source_run_id": "'00000000-0000-0000-0000-000000000000'"}, (BAD, "coarse_source_run_id")),
    ({"key": "'OBJ-WRONG'"}, ("RESULT_KEY_MISMATCH", "key")),
    ({"object_id": "concat(' ', object_id)", "key": "concat(' ', object_id)"}, (BAD, "job_identity")),
    ({"light_curve_revision": "0L"}, (BAD, "job_identity")),
    ({"execution_mode": "7"}, (BAD, "job_identity")),
    ({"execution_mode": "257"}, (BAD, "job_identity")),
    ({"versions": "named_struct('model_bundle_version', '')"}, (BAD, "job_identity")),
    ({"job_id": SOME_UUID}, ("RESULT_JOB_ID_MISMATCH", "job_id")),
    ({"run_id": SOME_UUID}, ("RESULT_RUN_ID_MISMATCH", "run_id")),
    ({"candidate_revision": "0L"}, (BAD, "candidate_revision")),
    ({"effective_epoch_count": "2L"}, (BAD, "effective_epoch_count")),
    ({"effective_epoch_count": "1025L"}, (BAD, "effective_epoch_count")),
    ({"coarse_source_type": "9"}, (BAD, "coarse_source_type")),
    ({"predicted_coarse_class": "999"}, (BAD, "predicted_coarse_class")),
    ({"predicted_leaf_class": "999"}, (BAD, "predicted_leaf_class")),
    ({"completed_at": "timestamp'0001-01-01 00:00:00'"}, (BAD, "completed_at")),
    ({"predicted_coarse_class": "if(predicted_coarse_class = 50, 30, 50)"}, (BAD, "predicted_coarse_class")),
    ({"predicted_leaf_class": "if(predicted_leaf_class = 30, 70, 30)"}, (BAD, "predicted_leaf_class")),
    ({"xgboost_executed": "not xgboost_executed"}, (BAD, "coarse_source")),
    ({"coarse_source_epoch_count": "2L"}, (BAD, "coarse_source")),
    ({"coarse_source_light_curve_revision": "light_curve_revision + 1"}, (BAD, "coarse_source")),
    ({"coarse_source_run_id": f"if(coarse_source_run_id is null, {SOME_UUID}, null)"}, (BAD, "coarse_source")),
    ({"coarse_source_type": "coarse_source_type % 3 + 1"}, (BAD, "coarse_source")),
    # of two faults the earlier rung is named
    ({"run_id": SOME_UUID, "predicted_leaf_class": "999"}, ("RESULT_RUN_ID_MISMATCH", "run_id")),
]

OFF = "coarse_source_consistency"
#: Names for a run that is its own coarse source, and for one that reuses another's.
CONSTRAINT_WAYS = [
    ({"object_id": "concat(' ', object_id)"}, ("object_id", "object_id")),
    ({"object_id": "''"}, ("object_id", "object_id")),
    ({"object_id": r"concat('\u00a0', object_id)"}, ("", "")),  # only spaces count here
    ({"candidate_revision": "0L"}, ("candidate_revision", "candidate_revision")),
    ({"light_curve_revision": "0L"}, (f"light_curve_revision,{OFF}", f"light_curve_revision,{OFF}")),
    ({"effective_epoch_count": "2L"}, (f"effective_epoch_count,{OFF}", "effective_epoch_count")),
    ({"effective_epoch_count": "CAST(NULL AS BIGINT)"}, (f"effective_epoch_count,{OFF}", "effective_epoch_count")),
    ({"execution_mode": "7"}, ("execution_mode", "execution_mode")),
    ({"coarse_source_type": "9"}, (f"coarse_source_type,{OFF}", f"coarse_source_type,{OFF}")),
    ({"coarse_source_light_curve_revision": "0L"}, (f"coarse_source_revision,{OFF}", "coarse_source_revision")),
    ({"coarse_source_epoch_count": "2L"}, (f"coarse_source_epoch_count,{OFF}", "coarse_source_epoch_count")),
    ({"coarse_source_run_id": "run_id"}, (f"coarse_source_not_self,{OFF}", "coarse_source_not_self")),
    ({"xgboost_executed": "not xgboost_executed"}, (OFF, OFF)),
    ({"model_bundle_version": "'b '"}, ("model_bundle_version", "model_bundle_version")),
    ({"coarse": "slice(coarse, 1, 6)"}, ("coarse_probabilities_shape", "coarse_probabilities_shape")),
    ({"fine": "transform(fine, (x, i) -> if(i = 3, null, x))"}, ("fine_probabilities_shape", "fine_probabilities_shape")),
    ({"leaf": "concat(leaf, slice(leaf, 1, 1))"}, ("leaf_probabilities_shape", "leaf_probabilities_shape")),
    ({"predicted_coarse_class": "9"}, ("predicted_coarse_class", "predicted_coarse_class")),
    ({"predicted_leaf_class": "9"}, ("predicted_leaf_class", "predicted_leaf_class")),
    ({"object_id": "CAST(NULL AS STRING)", "predicted_leaf_class": "9"}, ("object_id,predicted_leaf_class", "object_id,predicted_leaf_class")),
]


def _put(vector: str, place: int, value: str) -> str:
    return f"transform({vector}, (x, i) -> if(i = {place}, CAST({value} AS FLOAT), x))"


def _times(vector: str, by: str) -> str:
    return f"transform({vector}, x -> CAST(x * {by} AS FLOAT))"


OUTPUT_WAYS = [
    ({"coarse": "CAST(NULL AS ARRAY<FLOAT>)"}, "PROBABILITIES"),
    ({"fine": "slice(fine, 1, 9)"}, "PROBABILITIES"),
    ({"leaf": _put("leaf", 4, "'NaN'")}, "PROBABILITIES"),
    ({"coarse": _put("coarse", 0, "1.5")}, "PROBABILITIES"),
    ({"coarse": _put("coarse", 6, "-0.1")}, "PROBABILITIES"),
    ({"leaf": _put("leaf", 11, "NULL")}, "PROBABILITIES"),
    ({"fine": _put("fine", 0, "'Infinity'")}, "PROBABILITIES"),
    ({"executed": "CAST(NULL AS BOOLEAN)"}, "EXECUTED_FLAG"),
    ({"executed": "not executed"}, "EXECUTED_FLAG"),
    ({"coarse": _times("coarse", "0.9")}, "SUMS"),
    ({"fine": _put("fine", 9, "0")}, "SUMS"),
    ({"leaf": _times("leaf", "0.99")}, "SUMS"),
    ({"leaf": _put("leaf", 2, "'NaN'"), "executed": "not executed"}, "PROBABILITIES"),
    ({"coarse": _times("coarse", "0.9"), "executed": "not executed"}, "EXECUTED_FLAG"),
]

#: White space and other characters by code point, where they stand in an id, and whether the string is good.
STRING_WAYS = [({"text": f"concat(chr({code}), object_id)" if first else f"concat(object_id, chr({code}))"}, good) for code, first, good in ((32, True, False), (9, False, False), (10, True, False), (160, True, False), (133, False, False))] + [
    ({"text": r"concat('\u2003', object_id)"}, False),
    ({"text": r"concat(object_id, '\u3000')"}, False),
    ({"text": r"concat(object_id, '\u2028')"}, False),
    ({"text": r"concat('\u200b', object_id)"}, True),  # of no width, and no white space
    ({"text": "concat('a b ', object_id)"}, True),
    ({"text": "concat(object_id, chr(0), 'x')"}, False),
    ({"text": "chr(0)"}, False),
    ({"text": "''"}, False),
    ({"text": "CAST(NULL AS STRING)"}, False),
]


def _cycle(ways: list) -> Column:
    return ((derive.user_of(F.col("object_id")) * 5 + F.col("light_curve_revision")) % (len(ways) + 1)).cast("int")


def _sql_case(ways: list, values: list, sound: str = "NULL") -> str:
    listed = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values, 1))
    return f"CASE (user_id * 5 + light_curve_revision) % {len(ways) + 1} {listed} ELSE {sound} END"


def _spoilt(rows: DataFrame, ways: list) -> DataFrame:
    """rows (with ``k``) whose columns are changed as the way of k says; every expression sees the row as it was."""
    changed: dict[str, str] = {}
    for i, (changes, _) in enumerate(ways, 1):
        for c, value in changes.items():
            changed[c] = changed.get(c, "CASE k") + f" WHEN {i} THEN {value}"
    return rows.withColumns({c: F.expr(f"{text} ELSE {c} END") for c, text in changed.items()})


def result_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results spoilt in turn at each rung that can be reached, with what the ladder calls them."""
    rows = flow.derived_runs(spark, sf_dir).withColumns({"k": _cycle(RESULT_WAYS), "true_run_id": F.col("run_id"), "key": F.col("object_id")})
    rows = runs.to_result(rows).withColumns({"trace": F.expr(_null("trace")), "topic": F.lit(derive.RESULTS), "text": F.lit(None).cast("string")})
    rows = _spoilt(rows, RESULT_WAYS)
    message = F.coalesce(F.col("text").cast("binary"), encode(F.struct(*(f.name for f in RESULT))))
    sent = rows.select(F.col("key").cast("binary").alias("key"), message.alias("value"), "topic", "true_run_id")
    found = runs.validate_results(decode(sent, RESULT), derive.RESULTS)
    return found.select(F.col("true_run_id").alias("run_id"), F.col("error.code").alias("error_code"), F.col("error.field").alias("error_field"))


SQL_RESULT_RUNGS = f"""SELECT run_id, {_sql_case(RESULT_WAYS, [w[1][0] for w in RESULT_WAYS])} AS error_code,
  {_sql_case(RESULT_WAYS, [w[1][1] for w in RESULT_WAYS])} AS error_field FROM modes"""


def constraint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs spoilt in turn at each storage constraint, with the names of all that they break."""
    rows = _spoilt(flow.derived_runs(spark, sf_dir).withColumns({"k": _cycle(CONSTRAINT_WAYS), "true_run_id": F.col("run_id")}), CONSTRAINT_WAYS)
    return rows.select(F.col("true_run_id").alias("run_id"), F.array_join(runs.violated_constraints(), ",").alias("violated"))


SQL_CONSTRAINT_NAMES = f"""SELECT run_id, CASE WHEN mode = 'REUSE_PREVIOUS' THEN {_sql_case(CONSTRAINT_WAYS, [w[1][1] for w in CONSTRAINT_WAYS], "''")}
  ELSE {_sql_case(CONSTRAINT_WAYS, [w[1][0] for w in CONSTRAINT_WAYS], "''")} END AS violated FROM modes"""


def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the model spoilt in turn: null, short, long, not finite and out of range vectors, flags, sums."""
    rows = _spoilt(flow.derived_scored(spark, sf_dir).withColumn("k", _cycle(OUTPUT_WAYS)), OUTPUT_WAYS)
    return rows.select("run_id", scoring.output_error(F.col("mode")).alias("output_error"))


SQL_OUTPUT_ERRORS = f"SELECT run_id, {_sql_case(OUTPUT_WAYS, [w[1] for w in OUTPUT_WAYS])} AS output_error FROM modes"


def string_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with all kinds of white space and NUL at their ends and within."""
    rows = derive.revisions(derive.epochs(spark, sf_dir)).select("object_id", "light_curve_revision")
    rows = _spoilt(rows.withColumns({"k": _cycle(STRING_WAYS), "text": F.col("object_id")}), STRING_WAYS)
    return rows.select("object_id", "light_curve_revision", good_string(F.col("text")).alias("good"))


SQL_STRING_RULE = f"SELECT object_id, light_curve_revision, {_sql_case(STRING_WAYS, [str(w[1]).lower() for w in STRING_WAYS], 'true')}::BOOLEAN AS good FROM revs"
