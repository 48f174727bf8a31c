"""Queries that run the streams over files and must give what the batch gives."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions import status as S
from lumispark.functions.identity import run_id
from lumispark.operators import light_curves as L
from lumispark.operators import runs
from lumispark.plans import derive, flow
from lumispark.schemas import ENVELOPE, result_schema
from lumispark.sources.messages import encode, header, read_envelope_files
from lumispark.sources.shared import materialised, own_folder
from lumispark.sources.tables import RunStore
from lumispark.streaming import pipelines, worker

RESULT = result_schema()


def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the derived runs, with ``true_run_id``: some have a wrong key, some a wrong run id, some a wrong class."""
    rows = runs.to_result(flow.derived_runs(spark, sf_dir)).withColumn("true_run_id", F.col("run_id")).withColumn("trace", F.lit(None).cast(RESULT["trace"].dataType))
    user = derive.user_of(F.col("object_id"))
    rows = rows.withColumn("run_id", F.when(user % 10 == 1, F.lit("00000000-0000-5000-8000-000000000001")).otherwise(F.col("run_id")))
    other = F.when(F.col("predicted_leaf_class") == 30, 70).otherwise(30)
    rows = rows.withColumn("predicted_leaf_class", F.when(user % 10 == 3, other).otherwise(F.col("predicted_leaf_class")))
    return rows.select(
        F.when(user % 6 == 0, F.lit("OBJ-WRONG")).otherwise(F.col("object_id")).cast("binary").alias("key"),
        encode(F.struct(*(f.name for f in RESULT))).alias("value"),
        F.lit(derive.RESULTS).alias("topic"),
        "partition",
        "offset",
        F.col("completed_at").alias("timestamp"),
        F.lit(None).cast(ENVELOPE["headers"].dataType).alias("headers"),
        "true_run_id",
    )


def _arrive(rows: DataFrame, name: str, files: int = 3) -> tuple[DataFrame, str]:
    """A stream of the rows from a folder of some files, one file a batch."""
    folder = own_folder(rows.sparkSession, name)
    rows.repartition(files).write.parquet(f"{folder}/in")
    return _stream(rows, f"{folder}/in", 1), folder


def _stream(rows: DataFrame, folder: str, files: int) -> DataFrame:
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each command: a result, or a dead letter with its code. The light-curve store is down while the first
    batch runs: all its valid commands are retryable and wait, and the batches after take them up."""
    stream, folder = _arrive(derive.command_envelopes(spark, sf_dir), "commands")
    epochs = derive.epochs(spark, sf_dir)
    revisions = derive.revisions(epochs)
    calls = []

    def process(good: DataFrame) -> tuple[DataFrame, DataFrame]:
        calls.append(len(calls))
        tasks = good.select("*", *(f"m.{c}" for c in ("job_id", "object_id", "candidate_revision", "light_curve_revision", "declared_eligible_epoch_count", "model_bundle_version", "execution_mode")))
        checked = L.check_revisions(tasks, revisions, epochs)
        if len(calls) == 1:
            checked = checked.withColumn("cause", F.lit("SOURCE_UNAVAILABLE"))
        failed = checked.where("cause is not null").withColumn("operation", F.lit("prepare-input"))
        failed = failed.withColumn("failure", S.failure(F.col("cause"), F.col("operation")))
        done = checked.where("cause is null").select("job_id", run_id(F.col("job_id")).alias("run_id"), "partition", "offset")
        return done, failed

    pipelines.command_stream(stream, derive.COMMANDS, "commands-dlq", process, f"{folder}/out", f"{folder}/state").awaitTermination()
    done = spark.read.parquet(f"{folder}/out/results").select("partition", "offset", "job_id", F.lit(None).cast("string").alias("error_code"))
    dead = spark.read.parquet(f"{folder}/out/dead_letters")
    dead = dead.select(header("original-partition").cast("int").alias("partition"), header("original-offset").cast("long").alias("offset"), F.lit(None).cast("string").alias("job_id"), header("error-code").alias("error_code"))
    return done.unionByName(dead)


def stream_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs after commands came in three parts, by revision, each classified by a command stream and stored by a result
    stream before the next: modes, sources and coarse vectors must be those of the backlog in one pass."""
    folder, model = own_folder(spark, "worker"), flow.synthetic_model
    log = derive.commands(spark, sf_dir)
    user, revision = derive.user_of(F.col("object_id")), F.col("light_curve_revision")
    place = {"partition": (user % 3).cast("int"), "offset": user * 10 + revision, "timestamp": F.col("created_at")}
    log = materialised(log.withColumns(place).select(*ENVELOPE.names, "light_curve_revision"))
    epochs = materialised(derive.epochs(spark, sf_dir))
    bundles = spark.createDataFrame([(derive.BUNDLE,)], "model_bundle_version string")
    store = RunStore(spark, f"{folder}/store", 8)
    process = worker.classifying(store, derive.revisions(epochs), epochs, bundles, model, derive.RESULTS)
    for part in ("light_curve_revision <= 2", "light_curve_revision in (3, 4)", "light_curve_revision > 4"):
        log.where(part).drop("light_curve_revision").write.mode("append").parquet(f"{folder}/in")
        commands = read_envelope_files(spark, f"{folder}/in")
        pipelines.command_stream(commands, derive.COMMANDS, "commands-dlq", process, f"{folder}/out", f"{folder}/commands-state").awaitTermination()
        results = read_envelope_files(spark, f"{folder}/out/results")
        pipelines.result_stream(results, derive.RESULTS, "results-dlq", store.path, f"{folder}/results-state", buckets=8).awaitTermination()
    rows = store.runs()
    reused = F.col("coarse_source_type") == 2
    return rows.select(
        "run_id", "xgboost_executed", "coarse_source_type", "coarse_source_run_id", F.when(reused, F.col("coarse_source_light_curve_revision")).alias("source_revision"),
        *(F.round(F.get("coarse", F.lit(i)).cast("double"), 5).alias(f"c{i}") for i in range(7)),
    )


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table after the log came file by file, then again in one batch, then a part of it in two, each from a state of
    its own: how often each run is stored, and whether it is its object's current one."""
    log = result_envelopes(spark, sf_dir).drop("true_run_id")
    stream, folder = _arrive(log, "replays")
    log.where("pmod(offset, 3) = 0").repartition(2).write.parquet(f"{folder}/part")
    for state, rows in (("first", stream), ("whole", _stream(log, f"{folder}/in", 3)), ("part", _stream(log, f"{folder}/part", 1))):
        pipelines.result_stream(rows, derive.RESULTS, "results-dlq", f"{folder}/out", f"{folder}/state-{state}", buckets=8).awaitTermination()
    store = RunStore(spark, f"{folder}/out")
    current = store.current().select("run_id", F.lit(True).alias("is_current"))
    table = store.runs().groupBy("run_id").agg(F.count("*").cast("int").alias("stored"))
    return table.join(current, "run_id", "left").select("run_id", "stored", F.coalesce("is_current", F.lit(False)).alias("is_current"))


def result_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of the result stream, header by header."""
    stream, folder = _arrive(result_envelopes(spark, sf_dir).drop("true_run_id"), "letters")
    pipelines.result_stream(stream, derive.RESULTS, "results-dlq", f"{folder}/out", f"{folder}/state", buckets=4).awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/dead_letters")
    names = {"partition": "original-partition", "offset": "original-offset", "error_code": "error-code", "error_class": "error-class", "error_field": "error-field", "from_topic": "original-topic"}
    return rows.select("topic", F.col("key").cast("string").alias("key"), F.size("headers").alias("n_headers"), *(header(h).alias(c) for c, h in names.items()))


def candidate_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The commands and the dead letters that the candidate stream has written."""
    _, folder = _arrive(derive.candidate_envelopes(spark, sf_dir), "candidates")
    stream = read_envelope_files(spark, f"{folder}/in")
    pipelines.candidate_stream(stream, derive.CANDIDATES, derive.BUNDLE, derive.COMMANDS, "candidates-dlq", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out/commands"), spark.read.parquet(f"{folder}/out/dead_letters")


def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of commands and dead letters that the candidate stream has written."""
    commands, dead = candidate_rows(spark, sf_dir)
    count = lambda kind, rows: rows.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
    return count("command", commands).unionByName(count("dead_letter", dead))


def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table that the result stream has kept, each pointer met by its run. The stream is run twice over the
    same files, from two states: the second run replays everything and must change nothing."""
    stream, folder = _arrive(result_envelopes(spark, sf_dir).drop("true_run_id"), "results")
    for state in ("state", "again"):
        pipelines.result_stream(stream, derive.RESULTS, "results-dlq", f"{folder}/out", f"{folder}/{state}", buckets=4).awaitTermination()
    return _stored_pointers(RunStore(spark, f"{folder}/out"))


def _stored_pointers(store: RunStore) -> DataFrame:
    """The current pointers with how often the run of each is stored."""
    view = runs.current_view(store.current().drop("bucket"), store.runs().drop("partition", "offset", "persisted_at", "stream", "batch", "bucket"))
    return view.groupBy("object_id", "run_id", "light_curve_revision").agg(F.count("*").cast("int").alias("stored"))


class _Killed(Exception):
    """What stands for a lost driver."""


def stream_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table after a result stream that was killed in each of its batches: with its dead letters written, its
    runs and ids, its pointers, its commit but not Spark's. Each time it starts again from its checkpoint. The store is
    compacted on the way."""
    stream, folder = _arrive(result_envelopes(spark, sf_dir).drop("true_run_id"), "crashes", 5)
    kills = {("dead_letters", 0), ("runs", 1), ("current", 2), ("commit", 3), ("current", 4)}

    def after(step: str, n: int) -> None:
        if (step, n) in kills:
            kills.remove((step, n))
            raise _Killed(f"{step} of batch {n}")

    while True:
        query = pipelines.result_stream(stream, derive.RESULTS, "results-dlq", f"{folder}/out", f"{folder}/state", buckets=4, compact_every=2, after=after)
        try:
            query.awaitTermination()
            break
        except StreamingQueryException as e:
            if "_Killed" not in str(e):
                raise
    if kills:
        raise AssertionError(f"not killed at {kills}")
    return _stored_pointers(RunStore(spark, f"{folder}/out"))


def stream_alerts(spark: SparkSession, sf_dir: str, width: str = "1 hour", slide: str = "1 hour", least: float = 0.0) -> DataFrame:
    """Errors by window from a windowed stream, of windows with more than ``least``; a last sample far ahead closes every
    window before it."""
    events = derive.events(spark, sf_dir).where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("all").alias("service"), F.lit("error").alias("reason"), F.lit(1.0).alias("increase"))
    end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 60 days")).alias("ts"), F.lit("all").alias("service"), F.lit("end").alias("reason"), F.lit(0.0).alias("increase"))
    folder = own_folder(spark, "alerts")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    alerts = pipelines.windowed_alerts(stream, width, slide, "10 minutes", least)
    for part in (events, end):
        if part is end:
            part.write.mode("append").parquet(f"{folder}/in")
        alerts.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy(F.unix_timestamp("window_start").alias("at_s")).agg(F.sum("increase").cast("long").alias("errors"))


def stream_sliding_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three hours, one beginning every hour, in which over two errors came."""
    return stream_alerts(spark, sf_dir, "3 hours", "1 hour", 2.0)
