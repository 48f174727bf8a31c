"""All queries over the driver's tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions import status as S
from lumispark.functions import vectors as V
from lumispark.functions.identity import good_string, job_id, run_id
from lumispark.operators import candidates as C
from lumispark.operators import commands as M
from lumispark.operators import light_curves as L
from lumispark.operators import heavy, modes, operations, runs, scoring
from lumispark.plans import derive, failing, flow, sample_twins, state_twins
from lumispark.plans import stream_twins as twins
from lumispark.plans.derive import SQL_CANDIDATES, SQL_COMMANDS, SQL_EPOCHS, SQL_MODES, SQL_STATUS
from lumispark.schemas import COARSE, FINE, LEAF
from lumispark.sources.files import parse_light_curve_files, parse_revision_documents
from lumispark.sources.messages import decode, header
from lumispark.sources.shared import own_folder
from lumispark.sources.tables import save_history

FLAGSHIP = "current_classification"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def _rounded(a: str, i: int) -> str:
    return f"round({a}[{i}]::DOUBLE, 5)"


# ---- identity and candidates


@query(_with(SQL_EPOCHS, f"SELECT object_id, light_curve_revision, true AS good, j AS job_id, {derive.sql_run_id('j')} AS run_id FROM (SELECT *, {derive.sql_job_id('object_id', 'light_curve_revision', chr(39) + derive.BUNDLE + chr(39), 1)} AS j FROM revs)"))
def job_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.revisions(derive.epochs(spark, sf_dir)).select("object_id", "light_curve_revision", good_string(F.col("object_id")).alias("good"))
    rows = rows.withColumn("job_id", job_id(F.col("object_id"), F.col("light_curve_revision"), F.lit(derive.BUNDLE), F.lit(1)))
    return rows.withColumn("run_id", run_id(F.col("job_id")))


@query(_with(SQL_CANDIDATES, 'SELECT "partition", "offset", error_code, error_field FROM judged'))
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.validated_candidates(spark, sf_dir)
    return rows.select("partition", "offset", F.col("error.code").alias("error_code"), F.col("error.field").alias("error_field"))


@query(_with(SQL_COMMANDS, "SELECT job_id, object_id, light_curve_revision AS candidate_revision, light_curve_revision, declared AS declared_eligible_epoch_count, 'bundle-derived-v1' AS model_bundle_version, 1 AS execution_mode, 1 AS priority, at_s AS created_at_s, 'seed:' || object_id || ':' || light_curve_revision AS trace_id FROM cmd"))
def candidates_to_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.commands(spark, sf_dir)
    return rows.select(
        "job_id", "object_id", "candidate_revision", "light_curve_revision", "declared_eligible_epoch_count", "model_bundle_version", "execution_mode", "priority", F.unix_timestamp("created_at").alias("created_at_s"), F.col("trace.trace_id").alias("trace_id")
    )


@query(
    _with(
        SQL_CANDIDATES,
        """SELECT "partition", "offset", key, pos::INT AS pos, h.k AS header_key, h.v AS header_value FROM judged,
  (SELECT unnest(range(5)) AS pos) p, LATERAL (SELECT CASE pos WHEN 0 THEN 'origin' WHEN 1 THEN 'x-astro-error-code' WHEN 2 THEN 'x-astro-original-topic' WHEN 3 THEN 'x-astro-original-partition' ELSE 'x-astro-original-offset' END AS k,
  CASE pos WHEN 0 THEN 'events' WHEN 1 THEN error_code WHEN 2 THEN 'candidates' WHEN 3 THEN "partition"::VARCHAR ELSE "offset"::VARCHAR END AS v) h WHERE error_code IS NOT NULL""",
    )
)
def candidate_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = C.candidate_dead_letters(derive.validated_candidates(spark, sf_dir), "candidates-dlq")
    letters = letters.withColumn("partition", header("original-partition").cast("int")).withColumn("offset", header("original-offset").cast("long"))
    rows = letters.select("partition", "offset", F.col("key").cast("string").alias("key"), F.posexplode("headers").alias("pos", "h"))
    return rows.select("partition", "offset", "key", "pos", F.col("h.key").alias("header_key"), F.col("h.value").cast("string").alias("header_value"))


@query(
    _with(
        SQL_COMMANDS,
        """SELECT "partition", "offset", CASE WHEN user_id % 17 = 0 THEN 'COMMAND_EXECUTION_MODE_UNSUPPORTED' WHEN user_id % 13 = 0 THEN 'COMMAND_PRIORITY_UNSUPPORTED' WHEN user_id % 23 = 0 THEN 'COMMAND_DEADLINE_UNSUPPORTED' WHEN user_id % 19 = 0 THEN 'COMMAND_JOB_ID_MISMATCH' END AS error_code,
  CASE WHEN user_id % 17 = 0 THEN 'execution_mode' WHEN user_id % 13 = 0 THEN 'priority' WHEN user_id % 23 = 0 THEN 'deadline_at' WHEN user_id % 19 = 0 THEN 'job_id' END AS error_field FROM cmd""",
    )
)
def command_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.validated_commands(spark, sf_dir)
    return rows.select("partition", "offset", F.col("error.code").alias("error_code"), F.col("error.field").alias("error_field"))


# ---- light curves


@query(_with(SQL_STATUS, "SELECT object_id, light_curve_revision, actual_count, cause, CASE WHEN cause IS NULL THEN NULL ELSE 'PERMANENT' END AS error_class, CASE WHEN cause IS NULL THEN NULL ELSE 'LIGHT_CURVE_INVALID' END AS error_code FROM checked"))
def light_curve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derive.epochs(spark, sf_dir)
    rows = L.check_revisions(flow.derived_tasks(spark, sf_dir), derive.revisions(flat), flat)
    why = S.failure(F.col("cause"), F.lit("prepare-input"))
    bad = F.col("cause").isNotNull()
    return rows.select("object_id", "light_curve_revision", "actual_count", "cause", F.when(bad, why["class"]).alias("error_class"), F.when(bad, why["code"]).alias("error_code"))


@query(_with(SQL_EPOCHS, "SELECT object_id, light_curve_revision, row_number() OVER (PARTITION BY object_id, light_curve_revision ORDER BY observation_time, epoch_index)::INT AS place, observation_time, magnitude::DOUBLE AS magnitude, magnitude_error::DOUBLE AS magnitude_error FROM flat"))
def sorted_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.sorted_epochs(derive.epochs(spark, sf_dir))
    return rows.select("object_id", "light_curve_revision", "place", "observation_time", F.col("magnitude").cast("double").alias("magnitude"), F.col("magnitude_error").cast("double").alias("magnitude_error"))


@query(_with(SQL_EPOCHS, "SELECT object_id, light_curve_revision, epoch_index, observation_time FROM (SELECT *, lag(observation_time) OVER (PARTITION BY object_id, light_curve_revision ORDER BY observation_time, epoch_index) AS b FROM flat) WHERE b = observation_time"))
def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.adjacent_duplicates(derive.epochs(spark, sf_dir)).select("object_id", "light_curve_revision", "epoch_index", "observation_time")


@query(
    _with(
        SQL_STATUS,
        """, means AS (SELECT object_id, light_curve_revision, (list_reduce(list(magnitude ORDER BY observation_time), lambda a, x: (a + x)::FLOAT)::DOUBLE / count(*))::FLOAT AS mean FROM flat GROUP BY ALL),
 placed AS (SELECT f.*, n, mean, row_number() OVER w AS place, min(observation_time) OVER p AS t0 FROM flat f JOIN means USING (object_id, light_curve_revision) JOIN (SELECT object_id, light_curve_revision, n FROM checked WHERE cause IS NULL) USING (object_id, light_curve_revision)
  WINDOW p AS (PARTITION BY object_id, light_curve_revision), w AS (PARTITION BY object_id, light_curve_revision ORDER BY observation_time))
SELECT object_id, light_curve_revision, place::INT AS place, round((observation_time - (floor(t0) - 1))::FLOAT::DOUBLE, 4) AS t, round((magnitude - mean)::FLOAT::DOUBLE, 4) AS m, 1.0::DOUBLE AS mask, (CASE WHEN n <= 32 THEN 32 WHEN n <= 64 THEN 64 WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 512 THEN 512 WHEN n <= 768 THEN 768 ELSE 1024 END)::INT AS length_bucket FROM placed""",
    ).replace("\n, means", ", means")
)
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, _ = flow.derived_ready(spark, sf_dir)
    rows = L.model_vectors(ready)
    zipped = F.arrays_zip("normalised_times", "centred_magnitudes", F.slice("mask", F.lit(1), F.col("n").cast("int")).alias("mask"))
    rows = rows.select("object_id", "light_curve_revision", "length_bucket", F.posexplode(zipped).alias("p", "v"))
    return rows.select(
        "object_id", "light_curve_revision", (F.col("p") + 1).alias("place"), F.round(F.col("v.normalised_times").cast("double"), 4).alias("t"), F.round(F.col("v.centred_magnitudes").cast("double"), 4).alias("m"), F.col("v.mask").cast("double").alias("mask"), "length_bucket"
    )


# ---- modes and scoring


@query(
    _with(
        SQL_MODES,
        """SELECT object_id, light_curve_revision, (SELECT max(h.light_curve_revision) FROM ok h WHERE h.object_id = o.object_id AND h.light_curve_revision < o.light_curve_revision AND h.light_curve_revision <= 4) AS source_revision FROM ok o WHERE n > 20""",
    )
)
def compatible_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup among stored runs alone: all valid revisions up to 4, as if each had been executed."""
    probes, stored = _lookups(spark, sf_dir)
    return _hits(modes.as_of(probes, stored))


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ready, _ = flow.derived_ready(spark, sf_dir)
    as_run = {"effective_epoch_count": F.col("n"), "xgboost_executed": F.lit(True), "persisted_at": F.col("completed_at"), "coarse": F.array().cast("array<float>")}
    stored = ready.where("light_curve_revision <= 4").withColumns(as_run).select("object_id", "model_bundle_version", "light_curve_revision", "run_id", *as_run)
    return ready.where("n > 20").select("object_id", "model_bundle_version", "light_curve_revision"), stored


def _hits(found: DataFrame) -> DataFrame:
    sound = F.col("source").isNull() | modes.source_sound(F.col("light_curve_revision"), F.col("source"))
    return found.where(sound).select("object_id", "light_curve_revision", F.col("source.light_curve_revision").alias("source_revision"))


@query(ORACLE_SQL["compatible_coarse"])
def compatible_coarse_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup in a bucketed table of executed runs, which is not shuffled."""
    probes, stored = _lookups(spark, sf_dir)
    path = own_folder(spark, "history")
    history = save_history(stored, f"history_{path.rpartition('-')[2]}", path, 8)
    return _hits(modes.as_of_stored(probes, history, 8))


@query(
    _with(
        SQL_MODES,
        "SELECT run_id, object_id, light_curve_revision, n, mode, CASE mode WHEN 'COMPUTE_CURRENT' THEN 1 WHEN 'REUSE_PREVIOUS' THEN 2 ELSE 3 END AS coarse_source_type, source_run AS coarse_source_run_id, coalesce(source_revision, light_curve_revision) AS coarse_source_light_curve_revision, coalesce(source_n, n) AS coarse_source_epoch_count, mode <> 'REUSE_PREVIOUS' AS xgboost_executed FROM modes",
    )
)
def coarse_mode_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, _ = flow.derived_ready(spark, sf_dir)
    return ready.select("run_id", "object_id", "light_curve_revision", "n", "mode", "coarse_source_type", "coarse_source_run_id", "coarse_source_light_curve_revision", "coarse_source_epoch_count", "xgboost_executed")


SQL_SCORED = (
    SQL_MODES
    + """,
weights AS (
  SELECT *, list_transform(range(7), lambda i: (1 + (user_id * 31 + coarse_revision * 17 + i * 13) % 97)::DOUBLE) AS w,
            list_transform(range(10), lambda i: (1 + (user_id * 7 + light_curve_revision * 5 + i * 11) % 89)::DOUBLE) AS v FROM modes),
scored AS (
  SELECT *, list_transform(w, lambda x: (x / list_sum(w))::FLOAT) AS coarse, list_transform(range(1, 11), lambda i: (v[i] / (v[i] + v[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]))::FLOAT) AS fine FROM weights),
fused AS (
  SELECT *, [coarse[3]*fine[1], coarse[3]*fine[2], coarse[1]*fine[3], coarse[1]*fine[4], coarse[6]*fine[5], coarse[6]*fine[6], coarse[4]*fine[7], coarse[4]*fine[8], coarse[5]*fine[9], coarse[5]*fine[10], coarse[2], coarse[7]]::FLOAT[] AS leaf FROM scored),
classed AS (
  SELECT *, [50, 30, 60, 20, 10, 40, 70][list_position(coarse, list_max(coarse))] AS predicted_coarse_class,
            [6001, 6002, 5001, 5002, 4001, 4002, 2001, 2002, 1001, 1002, 30, 70][list_position(leaf, list_max(leaf))] AS predicted_leaf_class FROM fused)"""
)


@query(_with(SQL_SCORED, f"SELECT run_id, mode <> 'REUSE_PREVIOUS' AS executed, CAST(NULL AS VARCHAR) AS output_error, {', '.join(f'{_rounded("coarse", i + 1)} AS c{i}' for i in range(7))}, {', '.join(f'{_rounded("fine", i + 1)} AS f{i}' for i in range(10))} FROM classed"))
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.derived_scored(spark, sf_dir)
    value = lambda c, i: F.round(F.get(c, F.lit(i)).cast("double"), 5)
    return rows.select("run_id", "executed", scoring.output_error(F.col("mode")).alias("output_error"), *(value("coarse", i).alias(f"c{i}") for i in range(7)), *(value("fine", i).alias(f"f{i}") for i in range(10)))


@query(_with(SQL_SCORED, f"SELECT run_id, {', '.join(f'{_rounded("leaf", i + 1)} AS l{i}' for i in range(12))} FROM classed"))
def leaf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.derived_scored(spark, sf_dir).withColumn("fused", V.fuse(F.col("coarse"), F.col("fine")))
    return rows.select("run_id", *(F.round(F.get("fused", F.lit(i)).cast("double"), 5).alias(f"l{i}") for i in range(12)))


@query(_with(SQL_SCORED, "SELECT run_id, predicted_coarse_class::INT AS predicted_coarse_class, predicted_leaf_class::INT AS predicted_leaf_class FROM classed"))
def predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.predicted(flow.derived_scored(spark, sf_dir)).select("run_id", "predicted_coarse_class", "predicted_leaf_class")


@query(
    _with(
        SQL_SCORED,
        """SELECT run_id, 'coarse' AS vector, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, i)::INT AS rank, ['ROTATING','CATACLYSMIC','ECLIPSING_BINARY','LONG_PERIOD','PULSATING','RR_LYRAE','SUPERNOVA'][i] AS label, round(p::DOUBLE, 5) AS probability
  FROM (SELECT run_id, unnest(coarse) AS p, unnest(range(1, 8)) AS i FROM classed)""",
    )
)
def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.labelled(flow.derived_scored(spark, sf_dir), {"coarse": list(COARSE)})
    return rows.withColumn("probability", F.round(F.col("probability").cast("double"), 5))


@query(_with(SQL_SCORED, "SELECT run_id, true AS coarse_close, abs((coarse[1] * 1.001)::FLOAT::DOUBLE - coarse[1]) <= 2e-6 + 2e-3 * coarse[1] AS fine_close, false AS leaf_close FROM classed"))
def model_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored runs against themselves: as they are, a thousandth off, and a hundredth off."""
    a = flow.derived_scored(spark, sf_dir).select("run_id", "coarse", "fine", "leaf")
    off = lambda c, by: F.transform(c, lambda x: (x * by).cast("float"))
    return scoring.acceptance(a, a.withColumn("fine", off("fine", 1.001)).withColumn("leaf", off("leaf", 1.01)))


# ---- runs


@query(_with(SQL_SCORED, """SELECT run_id, CASE WHEN user_id % 6 = 0 THEN 'RESULT_KEY_MISMATCH' WHEN user_id % 10 = 1 THEN 'RESULT_RUN_ID_MISMATCH' WHEN user_id % 10 = 3 THEN 'RESULT_FIELD_INVALID' END AS error_code, CASE WHEN user_id % 6 = 0 THEN 'key' WHEN user_id % 10 = 1 THEN 'run_id' WHEN user_id % 10 = 3 THEN 'predicted_leaf_class' END AS error_field FROM classed"""))
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the derived runs, some with a wrong key, run id or class."""
    rows = twins.result_envelopes(spark, sf_dir)
    found = runs.validate_results(decode(rows, twins.RESULT), derive.RESULTS)
    return found.select(F.col("true_run_id").alias("run_id"), F.col("error.code").alias("error_code"), F.col("error.field").alias("error_field"))


@query(_with(SQL_SCORED, "SELECT run_id, CASE WHEN user_id % 6 = 0 THEN 'coarse_probabilities_shape' ELSE '' END || CASE WHEN user_id % 6 = 0 AND user_id % 10 = 4 THEN ',' ELSE '' END || CASE WHEN user_id % 10 = 4 THEN 'predicted_leaf_class' ELSE '' END AS violated FROM classed"))
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.derived_runs(spark, sf_dir)
    user = derive.user_of(F.col("object_id"))
    rows = rows.withColumn("coarse", F.when(user % 6 == 0, F.slice("coarse", 1, 6)).otherwise(F.col("coarse"))).withColumn("predicted_leaf_class", F.when(user % 10 == 4, 9).otherwise(F.col("predicted_leaf_class")))
    return rows.select("run_id", F.array_join(runs.violated_constraints(), ",").alias("violated"))


SQL_ARRIVALS = (
    SQL_SCORED
    + """,
arrived AS (SELECT run_id, job_id, object_id, user_id, light_curve_revision, 1 AS execution_mode, user_id % 3 AS p, user_id * 10 + [2, 0, 3, 1, 4][light_curve_revision] AS o FROM classed),
incoming AS (
  SELECT run_id, job_id, object_id, light_curve_revision, execution_mode, p, o FROM arrived
  UNION ALL SELECT run_id, job_id, object_id, light_curve_revision, execution_mode, p, o + 5000000 FROM arrived WHERE user_id % 2 = 0
  UNION ALL SELECT 'ffffffff' || substr(run_id, 9, 28), job_id, object_id, light_curve_revision, execution_mode, p, o + 9000000 FROM arrived WHERE user_id % 7 = 0
  UNION ALL SELECT 'eeeeeeee' || substr(run_id, 9, 28), 'eeeeeeee' || substr(job_id, 9, 28), object_id, light_curve_revision, 2, p, o + 7000000 FROM arrived WHERE user_id % 11 = 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY p, o) AS place, first_value(run_id) OVER (PARTITION BY job_id ORDER BY p, o) AS first_run FROM incoming),
judgedin AS (SELECT *, CASE WHEN first_run <> run_id THEN 'RESULT_REPOSITORY_CONFLICT' WHEN place = 1 THEN 'INSERTED' ELSE 'NO_OP' END AS outcome FROM firsts),
saved AS (
  SELECT j.*, outcome = 'INSERTED' AS inserted, outcome = 'INSERTED' AND execution_mode = 1 AND NOT EXISTS (SELECT 1 FROM judgedin b WHERE b.object_id = j.object_id AND b.outcome = 'INSERTED' AND b.execution_mode = 1 AND b.o < j.o AND b.light_curve_revision >= j.light_curve_revision) AS advanced FROM judgedin j)"""
)


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = flow.no_runs(spark)
    return runs.save_outcomes(flow.arrivals(spark, sf_dir), none, none.select("object_id", "run_id", "light_curve_revision"))


@query(_with(SQL_ARRIVALS, 'SELECT run_id, job_id, object_id, light_curve_revision, p::INT AS "partition", o AS "offset", outcome, inserted, advanced FROM saved'))
def save_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).select("run_id", "job_id", "object_id", "light_curve_revision", "partition", "offset", "outcome", "inserted", "advanced")


@query(_with(SQL_ARRIVALS, "SELECT outcome, inserted, advanced, count(*) AS attempts FROM saved GROUP BY ALL"))
def save_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outcome_counts(_saved(spark, sf_dir))


@query(_with(SQL_SCORED, "SELECT object_id, run_id, light_curve_revision, n AS effective_epoch_count, predicted_coarse_class::INT AS predicted_coarse_class, predicted_leaf_class::INT AS predicted_leaf_class FROM classed QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY light_curve_revision DESC) = 1"))
def current_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived events to the current classification of each object: the whole flow."""
    rows = flow.derived_runs(spark, sf_dir)
    view = runs.current_view(runs.current_pointers(rows), rows)
    return view.select("object_id", "run_id", "light_curve_revision", "effective_epoch_count", "predicted_coarse_class", "predicted_leaf_class")


@query(_with(SQL_MODES, "SELECT 'source_run' AS kind, run_id AS id FROM modes WHERE source_run IN (SELECT run_id FROM modes WHERE light_curve_revision = 2) UNION ALL SELECT 'current_run', run_id FROM modes WHERE light_curve_revision = 2"))
def run_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing once the runs of revision 2 are lost, with a pointer to every run."""
    rows = flow.derived_runs(spark, sf_dir)
    return runs.integrity(rows.where("light_curve_revision <> 2"), rows.select("object_id", "run_id", "light_curve_revision"))


@query(_with(SQL_MODES, "SELECT run_id, object_id FROM modes WHERE user_id % 9 = 4"))
def replay_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.derived_runs(spark, sf_dir)
    return runs.replay_gap(rows, rows.where(derive.user_of(F.col("object_id")) % 9 != 4)).select("run_id", "object_id")


@query(_with(SQL_MODES, "SELECT 1 AS commands, (cause IS NULL)::INT AS results, (cause IS NULL AND user_id % 9 <> 4)::INT AS runs, count(*) AS jobs FROM checked GROUP BY ALL"))
def pipeline_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = flow.derived_runs(spark, sf_dir)
    return operations.funnel(commands=derive.commands(spark, sf_dir), results=results, runs=results.where(derive.user_of(F.col("object_id")) % 9 != 4))


@query(_with(SQL_MODES, "SELECT object_id, run_id, light_curve_revision, row_number() OVER (PARTITION BY object_id ORDER BY light_curve_revision DESC)::INT AS place FROM modes"))
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = runs.history(flow.derived_runs(spark, sf_dir))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("light_curve_revision")))).select("object_id", "run_id", "light_curve_revision", "place")


@query(_with(SQL_MODES, "SELECT 'classification_runs' AS \"table\", count(*) AS rows FROM modes UNION ALL SELECT 'current_classifications', count(DISTINCT object_id) FROM modes"))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.derived_runs(spark, sf_dir)
    return runs.table_counts(rows, runs.current_pointers(rows))


# ---- dead letters, lag, skew

_LETTERS = (
    SQL_STATUS
    + """,
letters AS (
  SELECT 'candidate' AS stage, error_code, "partition", key AS object_id, "offset" FROM judged WHERE error_code IS NOT NULL
  UNION ALL SELECT 'command', 'LIGHT_CURVE_INVALID', "partition", object_id, "offset" FROM checked WHERE cause IS NOT NULL)"""
)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derive.epochs(spark, sf_dir)
    candidate = C.candidate_dead_letters(derive.validated_candidates(spark, sf_dir), "candidates-dlq").withColumn("stage", F.lit("candidate"))
    checked = L.check_revisions(flow.derived_tasks(spark, sf_dir), derive.revisions(flat), flat).where("cause is not null")
    user = derive.user_of(F.col("object_id"))
    failed = checked.withColumn("failure", S.failure(F.col("cause"), F.lit("prepare-input"))).select(
        F.col("object_id").cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), F.lit(derive.COMMANDS).alias("topic"), (user % 3).cast("int").alias("partition"), (user * 10 + F.col("light_curve_revision")).alias("offset"),
        F.col("completed_at").alias("timestamp"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"), "failure", F.lit("prepare-input").alias("operation"),
    )
    command = M.command_dead_letters(failed, "commands-dlq").withColumn("stage", F.lit("command"))
    letters = candidate.unionByName(command)
    return letters.select("stage", header("error-code").alias("error_code"), header("original-partition").cast("int").alias("partition"), F.col("key").cast("string").alias("object_id"), header("original-offset").cast("long").alias("offset"))


@query(_with(_LETTERS, 'SELECT stage, error_code, "partition"::INT AS "partition", object_id, count(*) AS letters, min("offset") AS first_offset, max("offset") AS last_offset FROM letters GROUP BY ALL'))
def dlq_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.dlq_triage(_letters(spark, sf_dir))


@query(
    _with(
        _LETTERS,
        """, codes AS (SELECT stage, error_code, count(*) AS c FROM letters GROUP BY ALL), tops AS (SELECT stage, sum(c) AS letters, max(c) AS top FROM codes GROUP BY ALL),
 spread AS (SELECT stage, count(DISTINCT "partition") AS partitions, count(DISTINCT object_id) AS objects FROM letters GROUP BY ALL)
SELECT stage, letters::BIGINT AS letters, partitions, objects, round(top / letters, 6) AS top_share, CASE WHEN partitions >= 2 AND top / letters >= 0.8 THEN 'systemic' ELSE 'isolated' END AS kind FROM tops JOIN spread USING (stage)""",
    ).replace("\n, codes", ", codes")
)
def dlq_growth_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.dlq_growth_kind(operations.dlq_triage(_letters(spark, sf_dir))).withColumn("top_share", F.round("top_share", 6))


@query(
    """WITH o AS (SELECT 'g' || (user_id % 2) AS "group", event_type AS topic, user_id % 3 AS "partition", max(event_id) AS e, min(event_id) AS c FROM events GROUP BY ALL)
SELECT "group", topic, "partition"::INT AS "partition", sum(e - c)::BIGINT AS lag FROM o GROUP BY ROLLUP ("group", topic, "partition")"""
)
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.events(spark, sf_dir)
    group = F.concat(F.lit("g"), (F.col("user_id") % 2).cast("string")).alias("group")
    offsets = e.groupBy(group, F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition")).agg(F.max("event_id").alias("end_offset"), F.min("event_id").alias("committed_offset"))
    return operations.lag(offsets)


@query(
    """WITH s AS (SELECT user_id % 3 AS "partition", date_trunc('hour', ts) AS h, count(*) AS n, sum(CASE WHEN hour(ts) % 4 = 0 THEN 0 WHEN event_type = 'error' THEN 0 ELSE 1 END) AS d FROM events GROUP BY ALL),
c AS (SELECT "partition", h, sum(n) OVER w AS e, sum(d) OVER w AS c FROM s WINDOW w AS (PARTITION BY "partition" ORDER BY h)),
g AS (SELECT *, e - lag(e) OVER w AS de, c - lag(c) OVER w AS dc FROM c WINDOW w AS (PARTITION BY "partition" ORDER BY h))
SELECT "partition"::INT AS "partition", epoch(h)::BIGINT AS at_s, CASE WHEN de IS NULL THEN 'first' WHEN de > 0 AND dc <= 0 THEN 'stuck' WHEN dc > 0 AND de > dc THEN 'capacity' ELSE 'ok' END AS diagnosis FROM g"""
)
def lag_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = derive.events(spark, sf_dir)
    done = F.when(F.hour("ts") % 4 == 0, 0).when(F.col("event_type") == "error", 0).otherwise(1)
    s = e.groupBy((F.col("user_id") % 3).cast("int").alias("partition"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count("*").alias("n"), F.sum(done).alias("d"))
    w = Window.partitionBy("partition").orderBy("ts")
    s = s.select(F.lit("g").alias("group"), F.lit("t").alias("topic"), "partition", "ts", F.sum("n").over(w).alias("end_offset"), F.sum("d").over(w).alias("committed_offset"))
    return operations.lag_diagnosis(s).select("partition", F.unix_timestamp("ts").alias("at_s"), "diagnosis")


@query("""SELECT (user_id % 3)::INT AS "partition", count(*) AS records, count(DISTINCT user_id) AS keys, round(count(*) / (SELECT count(*) FROM events), 9) AS share, round(67.0 * count(*) / (SELECT count(*) FROM events), 6) AS offered_load FROM events GROUP BY 1""")
def key_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.events(spark, sf_dir).select((F.col("user_id") % 3).cast("int").alias("partition"), F.col("user_id").alias("key"))
    return operations.key_skew(e, 67.0).withColumn("share", F.round("share", 9)).withColumn("offered_load", F.round("offered_load", 6))


# ---- metric samples: cumulative sums of cents by event type and pod, falling back to 0 at the start of each tenth day

_SAMPLES = """samples AS (
  SELECT event_type, user_id AS pod, ts, round(value * 100) AS cents, sum(round(value * 100)) OVER (PARTITION BY event_type, user_id, (day(ts) - 1) // 10 ORDER BY ts, event_id) AS v, event_id FROM events),
inc AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0.0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS increase, time_bucket(INTERVAL 6 hours, ts) AS ws FROM samples WINDOW w AS (PARTITION BY event_type, pod ORDER BY ts))"""
HOURS = 360


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = derive.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("pod", F.col("user_id"))
    cents = F.round(F.col("value") * 100)
    w = Window.partitionBy("event_type", "user_id", F.floor((F.dayofmonth("ts") - 1) / 10)).orderBy("ts", "event_id")
    return e.select("event_type", "pod", "ts", F.sum(cents).over(w).alias("value"), cents.alias("cents"))


def _increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.increases(_samples(spark, sf_dir), ["event_type", "pod"])


def _at(df: DataFrame) -> DataFrame:
    return df.withColumn("at_s", F.unix_timestamp("window_start")).drop("window_start")


@query(_with(_SAMPLES, "SELECT event_type, epoch(ws)::BIGINT AS at_s, round(sum(increase), 3) AS increase, round(sum(increase) / 21600.0, 6) AS rate FROM inc GROUP BY ALL"))
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations.windowed(_increases(spark, sf_dir), ["event_type"], HOURS)
    return _at(rows.withColumn("increase", F.round("increase", 3)).withColumn("rate", F.round("rate", 6)))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0)
_HISTOGRAM = "hist AS (SELECT event_type, le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END)::BIGINT AS cumulative FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 'infinity'::DOUBLE]) AS le) b GROUP BY ALL)"


@query(_with(_HISTOGRAM, "SELECT event_type, le, cumulative FROM hist"))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.duration_histogram(derive.events(spark, sf_dir), ["event_type"], "value", _BOUNDS)


@query(
    _with(
        _HISTOGRAM,
        """, b AS (SELECT event_type, le, cumulative, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS below, max(cumulative) OVER (PARTITION BY event_type) AS total FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (cumulative - below) END), 6) AS quantile FROM b WHERE cumulative >= 0.95 * total AND below < 0.95 * total GROUP BY ALL""",
    ).replace("\n, b AS", ", b AS")
)
def latency_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations.bucket_quantile(duration_histogram(spark, sf_dir), ["event_type"], 0.95)
    return rows.withColumn("quantile", F.round("quantile", 6))


@query(_with(_SAMPLES, "SELECT event_type, epoch(ws)::BIGINT AS at_s, round(CASE WHEN count(*) > 0 THEN sum(increase) / count(*) END, 4) AS mean FROM inc GROUP BY ALL"))
def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = _increases(spark, sf_dir)
    on = ["window_start", "event_type"]
    top = operations.windowed(inc, ["event_type"], HOURS)
    bottom = operations.windowed(inc.withColumn("increase", F.lit(1.0)), ["event_type"], HOURS)
    return _at(operations.ratio(top, bottom, on).withColumn("mean", F.round("mean", 4)))


@query(
    """WITH r AS (SELECT time_bucket(INTERVAL 6 hours, ts) AS ws, user_id % 4 AS pod, count(*) / 21600.0 AS rate, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / 21600.0 AS errors FROM events GROUP BY ALL),
f AS (SELECT *, errors / greatest(rate, 0.001) AS ratio, errors / greatest(rate, 0.001) > 0.2 AND rate > 0.0001 AS firing FROM r),
i AS (SELECT *, epoch(ws)::BIGINT // 21600 - row_number() OVER (PARTITION BY pod, firing ORDER BY ws) AS g FROM f)
SELECT pod::INT AS pod, epoch(ws)::BIGINT AS at_s, round(ratio, 6) AS ratio, firing, firing AND row_number() OVER (PARTITION BY pod, CASE WHEN firing THEN g END ORDER BY ws) >= 2 AS alert FROM i"""
)
def error_ratio_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).cast("int").alias("pod"), S.status_class(status).alias("status_class"), F.lit(1.0).alias("increase"))
    found = operations.error_ratio(rows, ["pod"], HOURS, share=0.2, least=0.0001)
    return _at(found).select("pod", "at_s", F.round("ratio", 6).alias("ratio"), "firing", "alert")


@query(
    _with(
        _SAMPLES,
        """, w AS (SELECT event_type, pod, ws, round(sum(increase), 3) AS increase FROM inc GROUP BY ALL)
SELECT a.event_type, a.pod, epoch(a.ws)::BIGINT AS at_s, a.increase, b.ws IS NULL AS is_new FROM w a LEFT JOIN w b ON b.event_type = a.event_type AND b.pod = a.pod AND b.ws = a.ws - INTERVAL 6 hours WHERE b.ws IS NULL OR a.increase > 0""",
    ).replace("\n, w AS", ", w AS")
)
def new_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations.windowed(_increases(spark, sf_dir), ["event_type", "pod"], HOURS).withColumn("increase", F.round("increase", 3))
    return _at(operations.new_series(rows.drop("rate"), ["event_type", "pod"], HOURS)).select("event_type", "pod", "at_s", "increase", "is_new")


@query("""SELECT user_id AS pod, max(CASE WHEN event_type = 'view' THEN value * 4 END) AS age, max(CASE WHEN event_type = 'purchase' THEN (regexp_extract(props, '([0-9]+)', 1)::INT % 2)::DOUBLE END) AS retrying FROM events GROUP BY ALL HAVING max(CASE WHEN event_type = 'view' THEN value * 4 END) > 60 AND max(CASE WHEN event_type = 'purchase' THEN regexp_extract(props, '([0-9]+)', 1)::INT % 2 END) > 0""")
def stuck_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.events(spark, sf_dir)
    age = e.where("event_type = 'view'").select(F.col("user_id").alias("pod"), F.lit("command_age_seconds").alias("name"), (F.col("value") * 4).alias("value"))
    again = e.where("event_type = 'purchase'").select(F.col("user_id").alias("pod"), F.lit("commands_retrying").alias("name"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2).cast("double").alias("value"))
    return operations.stuck_retry(age.unionByName(again))


@query(
    """WITH w AS (SELECT DISTINCT time_bucket(INTERVAL 6 hours, ts) AS ws FROM events WHERE event_type = 'error'), x AS (SELECT unnest(['0', '1', '9']) AS service)
SELECT epoch(w.ws)::BIGINT AS at_s, service, (SELECT count(*) FROM events e WHERE e.event_type = 'error' AND (e.user_id % 2)::VARCHAR = service AND time_bucket(INTERVAL 6 hours, e.ts) = w.ws)::DOUBLE AS increase FROM w, x"""
)
def failure_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.events(spark, sf_dir).where("event_type = 'error'")
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 2).cast("string").alias("service"), F.lit(1.0).alias("increase"))
    return _at(operations.failure_increase(rows, [("0",), ("1",), ("9",)], ["service"], HOURS))


# ---- files, documents and ad-hoc scoring, from the derived light curves


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of each object's revision 5, as CSV with a header for even users and with spaces for odd ones."""
    rows = derive.epochs(spark, sf_dir).where("light_curve_revision = 5")
    user = derive.user_of(F.col("object_id"))
    sep = F.when(user % 2 == 0, ",").otherwise(" ")
    line = F.concat(F.col("observation_time").cast("string"), sep, F.col("magnitude").cast("string"), sep, F.when(user % 47 == 0, F.lit("oops")).otherwise(F.col("magnitude_error").cast("string")))
    files = rows.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("epoch_index", line.alias("line")))).alias("l"))
    head = F.when(user % 2 == 0, "# observed\n\nMJD,Mag,Mag_err\n").otherwise("")
    return files.select(F.concat(F.lit("/in/"), "object_id", F.when(user % 2 == 0, ".csv").otherwise(".TXT")).alias("path"), F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))


@query(_with(SQL_EPOCHS, "SELECT object_id, CASE WHEN user_id % 47 = 0 THEN NULL ELSE count(*) END AS epochs, CASE WHEN user_id % 47 = 0 THEN 'number' END AS reason, CASE WHEN user_id % 47 = 0 THEN NULL ELSE round(min(observation_time), 6) END AS first_time FROM flat WHERE light_curve_revision = 5 GROUP BY object_id, user_id"))
def light_curve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, errors = parse_light_curve_files(_texts(spark, sf_dir))
    counts = good.groupBy("object_id").agg(F.count("*").alias("epochs"), F.round(F.min("observation_time"), 6).alias("first_time")).withColumn("reason", F.lit(None).cast("string"))
    return counts.unionByName(errors.select("object_id", "reason"), allowMissingColumns=True).select("object_id", "epochs", "reason", "first_time")


@query(_with(SQL_EPOCHS, "SELECT object_id, light_curve_revision, CASE WHEN user_id % 53 <> 0 THEN n END AS eligible_epoch_count, n AS epochs, user_id % 53 <> 0 AS consistent FROM revs"))
def revision_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derive.epochs(spark, sf_dir)
    rows = L.nested(flat, derive.revisions(flat))
    count = F.when(derive.user_of(F.col("object_id")) % 53 != 0, F.size("epochs").cast("long"))
    found = parse_revision_documents(rows.select(F.to_json(F.struct("object_id", "light_curve_revision", count.alias("eligible_epoch_count"), "epochs", F.lit(1).alias("unknown"))).alias("document")))
    return found.select("object_id", "light_curve_revision", "eligible_epoch_count", F.size("epochs").cast("long").alias("epochs"), "consistent")


@query(
    _with(
        SQL_EPOCHS,
        """SELECT object_id, n, CASE WHEN n <= 20 THEN 'COMPUTE_CURRENT' ELSE 'COMPUTE_BOOTSTRAP' END AS mode, round(w[1] / list_sum(w), 5) AS c0 FROM (SELECT r.*, list_transform(range(7), lambda i: (1 + (r.user_id * 31 + 5 * 17 + i * 13) % 97)::DOUBLE) AS w FROM revs r
  JOIN (SELECT object_id, light_curve_revision, count(DISTINCT observation_time) AS t, min(magnitude_error) AS e FROM flat GROUP BY ALL) USING (object_id, light_curve_revision) WHERE light_curve_revision = 5 AND user_id % 47 <> 0 AND n BETWEEN 3 AND 1024 AND t = n AND e > 0)""",
    )
)
def adhoc_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to probabilities without history: parse, check, choose a mode, score."""
    good, _ = parse_light_curve_files(_texts(spark, sf_dir))
    flat = good.withColumn("light_curve_revision", F.lit(5).cast("long")).withColumnRenamed("line", "epoch_index")
    asked = flat.groupBy(*L.KEY).agg(F.count("*").alias("eligible_epoch_count"))
    checked = L.check_revisions(asked.withColumn("declared_eligible_epoch_count", F.col("eligible_epoch_count")), asked, flat).where("cause is null")
    ready = L.nested(flat, checked).withColumn("mode", scoring.ad_hoc_mode(F.size("epochs")))
    scored = scoring.score(L.model_vectors(ready), flow.synthetic_model, ["object_id", "n", "mode"])
    return scored.select("object_id", "n", "mode", F.round(F.get("coarse", F.lit(0)).cast("double"), 5).alias("c0"))


@query(_with(SQL_EPOCHS, f"SELECT 'seed:' || object_id || ':' || light_curve_revision AS event_id, 1 AS event_type, object_id, light_curve_revision, n AS eligible_epoch_count, {derive.BEGIN} + light_curve_revision AS occurred_at_s FROM revs"))
def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.revisions(derive.epochs(spark, sf_dir)).withColumn("occurred_at", F.timestamp_seconds(F.lit(derive.BEGIN) + F.col("light_curve_revision")))
    seeded = C.seed_candidates(rows, "seed", "events", "v1")
    return seeded.select("event_id", "event_type", "object_id", "light_curve_revision", "eligible_epoch_count", F.unix_timestamp("occurred_at").alias("occurred_at_s"))


# ---- streams: the same rows, from files that arrive, must come out as from the batch

# What the command ladder says of the spoilt envelopes, then what the light curve check says of the others.
SQL_COMMAND_CODES = """CASE WHEN user_id % 17 = 0 THEN 'COMMAND_EXECUTION_MODE_UNSUPPORTED' WHEN user_id % 13 = 0 THEN 'COMMAND_PRIORITY_UNSUPPORTED'
  WHEN user_id % 23 = 0 THEN 'COMMAND_DEADLINE_UNSUPPORTED' WHEN user_id % 19 = 0 THEN 'COMMAND_JOB_ID_MISMATCH' WHEN cause IS NOT NULL THEN 'LIGHT_CURVE_INVALID' END"""
SQL_RESULT_CODES = """CASE WHEN user_id % 6 = 0 THEN 'RESULT_KEY_MISMATCH' WHEN user_id % 10 = 1 THEN 'RESULT_RUN_ID_MISMATCH' WHEN user_id % 10 = 3 THEN 'RESULT_FIELD_INVALID' END"""
SQL_RESULT_FIELDS = """CASE WHEN user_id % 6 = 0 THEN 'key' WHEN user_id % 10 = 1 THEN 'run_id' ELSE 'predicted_leaf_class' END"""
SQL_LETTER_PLACE = """user_id * 10 + [2, 0, 3, 1, 4][light_curve_revision]"""


def run_build_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tasks, some of them spoilt, that give no run: a declared count that is not the epochs', an executed flag that does
    not fit the mode, a time of year 1, a source type that is not the mode's."""
    rows = flow.derived_scored(spark, sf_dir)
    user = derive.user_of(F.col("object_id"))
    rows = rows.withColumn("declared_eligible_epoch_count", F.when(user % 10 == 2, F.col("declared_eligible_epoch_count") + 1).otherwise(F.col("declared_eligible_epoch_count")))
    rows = rows.withColumn("executed", F.when(user % 10 == 4, ~F.col("executed")).otherwise(F.col("executed")))
    rows = rows.withColumn("completed_at", F.when(user % 10 == 6, F.lit("0001-01-01 00:00:00").cast("timestamp")).otherwise(F.col("completed_at")))
    rows = rows.withColumn("coarse_source_type", F.when(user % 10 == 8, F.pmod("coarse_source_type", F.lit(3)) + 1).otherwise(F.col("coarse_source_type")))
    return runs.unbuilt(rows).select("job_id", "cause", "failure.class", "failure.code")


def executed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models: the coarse one only where the mode computes; a reused vector is kept bit for bit, here one of whole eighths."""
    ready, _ = flow.derived_ready(spark, sf_dir)
    given = F.array(*(F.lit(x).cast("float") for x in (0.25, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125)))
    rows = L.model_vectors(ready).withColumn("source", F.struct(given.alias("coarse")))
    half = lambda: lambda b: b.assign(fine=[[0.5] * 10] * len(b))
    even = lambda: lambda b: b.assign(coarse=[[0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0]] * len(b))
    out = scoring.score_split(rows, even, half, ["run_id"])
    return out.select("run_id", "executed", *(F.get("coarse", F.lit(i)).cast("double").alias(f"c{i}") for i in (0, 1, 2)), *(F.get("leaf", F.lit(i)).cast("double").alias(f"l{i}") for i in (0, 2, 10)))


def bundle_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of objects divisible by 4 ask for a bundle that nobody has; a bad light curve is named before it."""
    epochs = derive.epochs(spark, sf_dir)
    user = derive.user_of(F.col("object_id"))
    tasks = flow.derived_tasks(spark, sf_dir).withColumn("model_bundle_version", F.when(user % 4 == 0, "bundle-of-nobody").otherwise(F.col("model_bundle_version")))
    bundles = spark.createDataFrame([(derive.BUNDLE,)], "model_bundle_version string")
    _, failed = flow.prepare(tasks, derive.revisions(epochs), epochs, bundles, flow.no_runs(spark))
    why = S.failure(F.col("cause"), F.lit("prepare-input"))
    return failed.select("object_id", "light_curve_revision", "cause", why["class"].alias("error_class"), why["code"].alias("error_code"))


def funnel_from_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel from its first stage on: every candidate names a job, whether or not it is accepted."""
    seen = derive.revisions(derive.epochs(spark, sf_dir)).select(job_id(F.col("object_id"), F.col("light_curve_revision"), F.lit(derive.BUNDLE), F.lit(1)).alias("job_id"))
    results = flow.derived_runs(spark, sf_dir)
    stored = results.where(derive.user_of(F.col("object_id")) % 9 != 4)
    return operations.funnel(candidates=seen, commands=derive.commands(spark, sf_dir), results=results, runs=stored)


def request_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by method and status class; the method of an event is made of its type."""
    e = derive.events(spark, sf_dir)
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "POST").when(F.col("event_type") == "purchase", "post")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("user_id") % 2 == 0, 204)
    return e.groupBy(S.method_label(method).alias("method"), S.status_class(status).alias("status_class")).agg(F.count("*").alias("requests"))


QUERIES |= {"funnel_from_candidates": funnel_from_candidates, "request_labels": request_labels}
ORACLE_SQL |= {
    "funnel_from_candidates": _with(
        SQL_MODES,
        """SELECT 1 AS candidates, (k.job_id IS NOT NULL)::INT AS commands, (k.job_id IS NOT NULL AND k.cause IS NULL)::INT AS results,
  (k.job_id IS NOT NULL AND k.cause IS NULL AND r.user_id % 9 <> 4)::INT AS runs, count(*) AS jobs FROM revs r LEFT JOIN checked k USING (object_id, light_curve_revision) GROUP BY ALL""",
    ),
    "request_labels": """SELECT CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' ELSE 'OTHER' END AS method,
  CASE WHEN event_type = 'error' THEN '5xx' WHEN user_id % 2 = 0 THEN '2xx' ELSE 'transport_error' END AS status_class, count(*) AS requests FROM events GROUP BY ALL""",
}
QUERIES |= {"run_build_check": run_build_check, "executed_only": executed_only, "bundle_misses": bundle_misses}
ORACLE_SQL |= {
    "run_build_check": _with(
        SQL_MODES,
        """SELECT job_id, CASE WHEN user_id % 10 = 8 THEN 'COARSE_SOURCE_INVALID' ELSE 'RUN_INVALID' END AS cause, 'PERMANENT' AS class,
  CASE WHEN user_id % 10 = 8 THEN 'WORKER_INTERNAL_INVALID' ELSE 'CLASSIFICATION_RESULT_INVALID' END AS code FROM modes WHERE user_id % 10 IN (2, 4, 6, 8)""",
    ),
    "executed_only": _with(
        SQL_MODES,
        """SELECT run_id, x AS executed, CASE WHEN x THEN 0.5 ELSE 0.25 END::DOUBLE AS c0, CASE WHEN x THEN 0.5 ELSE 0.125 END::DOUBLE AS c1, CASE WHEN x THEN 0 ELSE 0.125 END::DOUBLE AS c2,
  CASE WHEN x THEN 0 ELSE 0.0625 END::DOUBLE AS l0, CASE WHEN x THEN 0.25 ELSE 0.125 END::DOUBLE AS l2, CASE WHEN x THEN 0.5 ELSE 0.125 END::DOUBLE AS l10 FROM (SELECT *, mode <> 'REUSE_PREVIOUS' AS x FROM modes)""",
    ),
    "bundle_misses": _with(
        SQL_STATUS,
        """SELECT object_id, light_curve_revision, coalesce(cause, 'BUNDLE_NOT_FOUND') AS cause, 'PERMANENT' AS error_class,
  CASE WHEN cause IS NULL THEN 'MODEL_BUNDLE_NOT_FOUND' ELSE 'LIGHT_CURVE_INVALID' END AS error_code FROM checked WHERE cause IS NOT NULL OR user_id % 4 = 0""",
    ),
}

QUERIES |= {"stream_commands": twins.stream_commands, "stream_replay": twins.stream_replay, "result_dlq": twins.result_letters}
ORACLE_SQL |= {
    "stream_commands": _with(
        SQL_STATUS, f"""SELECT "partition"::INT AS "partition", "offset", CASE WHEN code IS NULL THEN job_id END AS job_id, code AS error_code FROM (SELECT *, {SQL_COMMAND_CODES} AS code FROM checked)"""
    ),
    "stream_replay": _with(
        SQL_MODES,
        f"""SELECT run_id, 1 AS stored, row_number() OVER (PARTITION BY object_id ORDER BY light_curve_revision DESC) = 1 AS is_current FROM modes WHERE ({SQL_RESULT_CODES}) IS NULL""",
    ),
    "result_dlq": _with(
        SQL_MODES,
        f"""SELECT 'results-dlq' AS topic, CASE WHEN user_id % 6 = 0 THEN 'OBJ-WRONG' ELSE object_id END AS key, 6 AS n_headers, (user_id % 3)::VARCHAR AS "partition", ({SQL_LETTER_PLACE})::VARCHAR AS "offset",
  {SQL_RESULT_CODES} AS error_code, 'PERMANENT' AS error_class, {SQL_RESULT_FIELDS} AS error_field, 'results' AS from_topic FROM modes WHERE ({SQL_RESULT_CODES}) IS NOT NULL""",
    ),
}
QUERIES |= {"stream_candidates": twins.stream_candidates, "stream_results": twins.stream_results, "stream_crash": twins.stream_crash, "stream_alerts": twins.stream_alerts}
ORACLE_SQL |= {
    "stream_candidates": _with(SQL_COMMANDS, "SELECT 'command' AS kind, count(*) AS rows FROM cmd UNION ALL SELECT 'dead_letter', count(*) FROM judged WHERE error_code IS NOT NULL"),
    "stream_results": ORACLE_SQL["current_classification"].replace("n AS effective_epoch_count, predicted_coarse_class::INT AS predicted_coarse_class, predicted_leaf_class::INT AS predicted_leaf_class", "1 AS stored").replace("QUALIFY", "WHERE user_id % 6 <> 0 AND user_id % 10 NOT IN (1, 3) QUALIFY"),
    "stream_alerts": "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS at_s, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL",
}
ORACLE_SQL["stream_crash"] = ORACLE_SQL["stream_results"]
QUERIES |= {"stream_worker": twins.stream_worker, "stream_sliding_alerts": twins.stream_sliding_alerts}
ORACLE_SQL["stream_sliding_alerts"] = """SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT - 3600 * k AS at_s, count(*) AS errors
FROM events, (SELECT unnest(range(3)) AS k) WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 2"""
ORACLE_SQL["stream_worker"] = _with(
    SQL_SCORED,
    f"""SELECT run_id, mode <> 'REUSE_PREVIOUS' AS xgboost_executed, CASE mode WHEN 'COMPUTE_CURRENT' THEN 1 WHEN 'REUSE_PREVIOUS' THEN 2 ELSE 3 END::INT AS coarse_source_type,
  source_run AS coarse_source_run_id, source_revision, {', '.join(f'{_rounded("coarse", i + 1)} AS c{i}' for i in range(7))} FROM classed""",
)


def sample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_twins.sample_rates(_samples(spark, sf_dir), HOURS)
    return _at(rows.withColumn("increase", F.round("increase", 3)).withColumn("rate", F.round("rate", 6)))


def sample_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_twins.sample_quantiles(duration_histogram(spark, sf_dir), 0.95).withColumn("quantile", F.round("quantile", 6))


QUERIES |= {"sample_rates": sample_rates, "sample_quantiles": sample_quantiles, "stream_current": sample_twins.stream_current}
ORACLE_SQL |= {
    "sample_rates": ORACLE_SQL["counter_rate"],
    "sample_quantiles": ORACLE_SQL["latency_quantile"],
    "stream_current": _with(
        SQL_MODES,
        "SELECT object_id, run_id, light_curve_revision, true AS each_once FROM modes QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY light_curve_revision DESC) = 1",
    ),
}


@query(
    """WITH k AS (SELECT CASE WHEN event_id % 3 = 0 THEN user_id % 7 ELSE event_id + 1000000 END AS key FROM events)
SELECT key::BIGINT AS key, count(*) AS records, round(count(*) / (SELECT count(*) FROM k), 9) AS share FROM k GROUP BY key HAVING count(*) >= 0.045 * (SELECT count(*) FROM k)"""
)
def key_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which two thirds occur once, and seven hold the rest: those with 4.5% of all."""
    key = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).otherwise(F.col("event_id") + 1_000_000).cast("long")
    return heavy.key_shares(derive.events(spark, sf_dir).select(key.alias("key")), "key", 0.045).withColumn("share", F.round("share", 9))


# ---- every rung, constraint and check with rows that fail it


@query(_with(SQL_MODES, failing.SQL_RESULT_RUNGS))
def result_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing.result_rungs(spark, sf_dir)


@query(_with(SQL_MODES, failing.SQL_CONSTRAINT_NAMES))
def constraint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing.constraint_names(spark, sf_dir)


@query(_with(SQL_MODES, failing.SQL_OUTPUT_ERRORS))
def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing.output_errors(spark, sf_dir)


@query(_with(SQL_EPOCHS, failing.SQL_STRING_RULE))
def string_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing.string_rule(spark, sf_dir)


# ---- streams with typed state and timers

_CHANGES = """f AS (SELECT *, {firing} AS firing FROM r),
a AS (SELECT pod, ws, epoch(ws)::BIGINT // 21600 - row_number() OVER (PARTITION BY pod ORDER BY ws) AS g FROM f WHERE firing),
spans AS (SELECT pod, epoch(min(ws))::BIGINT AS first, epoch(max(ws))::BIGINT AS last FROM a GROUP BY pod, g HAVING count(*) >= 2)
SELECT pod, first + 21600 AS at_s, 'raised' AS change FROM spans UNION ALL SELECT pod, last + 21600, 'cleared' FROM spans"""


@query(ORACLE_SQL["stream_current"])
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_twins.stream_resumed(spark, sf_dir)


@query(
    """WITH r AS (SELECT time_bucket(INTERVAL 6 hours, ts) AS ws, (user_id % 4)::INT AS pod, count(*) / 21600.0 AS rate,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / 21600.0 AS errors FROM events GROUP BY ALL),
"""
    + _CHANGES.format(firing="errors / greatest(rate, 0.001) > 0.2 AND rate > 0.0001")
)
def stream_error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_twins.stream_error_alerts(spark, sf_dir, HOURS)


@query(
    """WITH r AS (SELECT time_bucket(INTERVAL 6 hours, ts) AS ws, (user_id % 5)::INT AS pod, max(CASE WHEN event_type = 'view' THEN value * 4 END) AS age,
  max(CASE WHEN event_type = 'purchase' THEN regexp_extract(props, '([0-9]+)', 1)::INT % 2 END) AS retrying FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL),
"""
    + _CHANGES.format(firing="coalesce(age > 200 AND retrying > 0, false)")
)
def stream_retry_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_twins.stream_retry_alerts(spark, sf_dir, HOURS)


@query(ORACLE_SQL["new_series"])
def stream_new_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _increases(spark, sf_dir).withColumn("id", F.xxhash64("event_type", "pod", "ts"))
    rows = state_twins.stream_new_series(samples, HOURS).withColumn("increase", F.round("increase", 3))
    return rows.select("event_type", "pod", "at_s", "increase", "is_new")


ORACLE_SQL["leaf_labels"] = _with(SQL_SCORED, f"SELECT run_id, {list(LEAF)}[list_position(leaf, list_max(leaf))] AS label FROM classed".replace("'", "'"))


def leaf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.predicted(flow.derived_scored(spark, sf_dir))
    return rows.select("run_id", S.name_of(F.col("predicted_leaf_class"), LEAF).alias("label"))


QUERIES["leaf_labels"] = leaf_labels
assert len(FINE) == 10
