"""Light curves, candidates, commands and samples derived from the driver's ``events`` table, in Spark and as SQL.

An event that is no error is an observation of its user's object; a revision holds all observations up to its part of the
month, so early revisions are short and later ones reuse earlier coarse results. Some users break some rule each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.operators import candidates as C
from lumispark.schemas import CANDIDATE, COMMAND, EXECUTION_MODES
from lumispark.sources.messages import decode, encode

BUNDLE, CANDIDATES, COMMANDS, RESULTS = "bundle-derived-v1", "candidates", "commands", "results"
#: Seconds of the first occurrence: 2024-02-01 UTC.
BEGIN = 1_706_745_600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def object_of(user: Column) -> Column:
    digits = user.cast("string")  # six at least; lpad would cut longer ones
    return F.concat(F.lit("OBJ-"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def user_of(object_id: Column) -> Column:
    return F.substr(object_id, F.lit(5)).cast("int")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat epochs: object_id, light_curve_revision, epoch_index, observation_time, magnitude, magnitude_error."""
    e = events(spark, sf_dir).where("event_type <> 'error'")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select(
        "user_id",
        F.col("event_id").alias("epoch_index"),
        (micros / F.lit(86400000000.0) + 40587.0).alias("observation_time"),
        F.col("value").cast("float").alias("magnitude"),
        ((k + F.when(F.col("event_type") == "purchase", 0).otherwise(1)) / F.lit(1000.0)).cast("float").alias("magnitude_error"),
        F.least(F.lit(5), 1 + F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int").alias("part"),
    )
    first = e.where("user_id % 31 = 0").groupBy("user_id").agg(F.min("epoch_index").alias("epoch_index"))
    again = e.join(first, ["user_id", "epoch_index"], "left_semi").withColumn("epoch_index", F.col("epoch_index") + 1_000_000_000)
    rows = e.unionByName(again).withColumn("light_curve_revision", F.explode(F.sequence(F.col("part").cast("long"), F.lit(5).cast("long"))))
    rows = rows.where("not (user_id % 5 = 0 and light_curve_revision < 3)")
    return rows.select(object_of(F.col("user_id")).alias("object_id"), "light_curve_revision", "epoch_index", "observation_time", "magnitude", "magnitude_error")


def revisions(flat: DataFrame) -> DataFrame:
    n = flat.groupBy("object_id", "light_curve_revision").agg(F.count("*").alias("n"))
    wrong = ((user_of(F.col("object_id")) % 29 == 0) & (F.col("light_curve_revision") == 3)).cast("int")
    return n.select("object_id", "light_curve_revision", F.col("n").alias("eligible_epoch_count"), (F.col("n") + wrong).alias("declared"))


def candidate_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope for each revision."""
    user, r = user_of(F.col("object_id")), F.col("light_curve_revision")
    rows = revisions(epochs(spark, sf_dir)).withColumn("eligible_epoch_count", F.col("declared")).withColumn("occurred_at", F.timestamp_seconds(F.lit(BEGIN) + r * 86400 + user))
    first = ((user % 5 != 0) & (r == 1)) | ((user % 5 == 0) & (r == 3))
    seeded = C.seed_candidates(rows, "seed", "events", "v1").withColumn("event_type", F.when(user % 37 == 0, 3).when(first, 1).otherwise(2))
    value = F.when(user % 43 == 0, F.lit("{bad").cast("binary")).otherwise(encode(F.struct(*(f.name for f in CANDIDATE))))
    return seeded.select(
        F.when(user % 41 == 0, F.lit("OBJ-WRONG")).otherwise(F.col("object_id")).cast("binary").alias("key"),
        value.alias("value"),
        F.lit(CANDIDATES).alias("topic"),
        (user % 3).cast("int").alias("partition"),
        (user * 10 + r).cast("long").alias("offset"),
        F.col("occurred_at").alias("timestamp"),
        F.array(F.struct(F.lit("origin").alias("key"), F.lit("events").cast("binary").alias("value"))).alias("headers"),
    )


def validated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_candidates(decode(candidate_envelopes(spark, sf_dir), CANDIDATE), CANDIDATES)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.commands(validated_candidates(spark, sf_dir), BUNDLE, COMMANDS)


def command_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command envelopes, some of them spoilt."""
    rows = commands(spark, sf_dir)
    user = user_of(F.col("object_id"))
    rows = (
        rows.withColumn("priority", F.when(user % 13 == 0, 2).otherwise(F.col("priority")))
        .withColumn("execution_mode", F.when(user % 17 == 0, 7).otherwise(F.col("execution_mode")))
        .withColumn("job_id", F.when(user % 19 == 0, F.lit("00000000-0000-5000-8000-000000000001")).otherwise(F.col("job_id")))
        .withColumn("deadline_at", F.when(user % 23 == 0, F.col("created_at")))
    )
    return rows.select(
        "key", encode(F.struct(*(f.name for f in COMMAND))).alias("value"), "topic", (user % 3).cast("int").alias("partition"), (user * 10 + F.col("light_curve_revision")).alias("offset"), F.col("created_at").alias("timestamp"), "headers"
    )


# ---- the same as SQL: common table expressions that an oracle begins with

_DIGIT = "instr('0123456789abcdef', substr({h}, 17, 1)) - 1"


def sql_uuid5(namespace: str, name: str) -> str:
    h = f"sha1({namespace} || {name})"
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab', (({_DIGIT.format(h=h)}) % 4) + 1, 1)||substr({h},18,3)||'-'||substr({h},21,12)"


def sql_prefixed(s: str) -> str:
    return f"unhex(lpad(to_hex(strlen({s})), 8, '0')) || ({s})::blob"


def sql_job_id(o: str, r: str, bundle: str, mode: int) -> str:
    name = f"{sql_prefixed(chr(39) + 'astro.classification.job.v1' + chr(39))} || {sql_prefixed(o)} || unhex(lpad(to_hex({r}), 16, '0')) || {sql_prefixed(bundle)} || unhex('0{mode}')"
    return sql_uuid5("unhex('6ba7b8119dad11d180b400c04fd430c8')", name)


def sql_run_id(job: str) -> str:
    return sql_uuid5(f"unhex(replace({job}, '-', ''))", "'classification-run-v1'::blob")


SQL_EPOCHS = """
base AS (
  SELECT user_id, event_id AS epoch_index, epoch_us(ts) / 86400000000.0 + 40587.0 AS observation_time, value::FLOAT AS magnitude,
         ((regexp_extract(props, '([0-9]+)', 1)::INT + CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) / 1000.0::DOUBLE)::FLOAT AS magnitude_error,
         least(5, 1 + (day(ts) - 1) // 6) AS part
  FROM events WHERE event_type <> 'error'),
both_ AS (
  SELECT * FROM base UNION ALL
  SELECT user_id, epoch_index + 1000000000, observation_time, magnitude, magnitude_error, part
  FROM base QUALIFY user_id % 31 = 0 AND row_number() OVER (PARTITION BY user_id ORDER BY epoch_index) = 1),
flat AS (
  SELECT 'OBJ-' || lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INT, '0') AS object_id, user_id, r::BIGINT AS light_curve_revision, epoch_index, observation_time, magnitude, magnitude_error
  FROM both_, range(1, 6) t(r) WHERE r >= part AND NOT (user_id % 5 = 0 AND r < 3)),
revs AS (
  SELECT object_id, user_id, light_curve_revision, count(*) AS n, count(*) + CASE WHEN user_id % 29 = 0 AND light_curve_revision = 3 THEN 1 ELSE 0 END AS declared
  FROM flat GROUP BY object_id, user_id, light_curve_revision)"""

SQL_CANDIDATES = (
    SQL_EPOCHS
    + f""",
cand AS (
  SELECT *, CASE WHEN user_id % 37 = 0 THEN 3 WHEN (user_id % 5 <> 0 AND light_curve_revision = 1) OR (user_id % 5 = 0 AND light_curve_revision = 3) THEN 1 ELSE 2 END AS event_type,
         CASE WHEN user_id % 41 = 0 THEN 'OBJ-WRONG' ELSE object_id END AS key, {BEGIN} + light_curve_revision * 86400 + user_id AS at_s, user_id % 3 AS "partition", user_id * 10 + light_curve_revision AS "offset"
  FROM revs),
judged AS (
  SELECT *, CASE WHEN user_id % 43 = 0 THEN 'CANDIDATE_PROTO_MALFORMED' WHEN event_type = 3 THEN 'CANDIDATE_EVENT_TYPE_UNSUPPORTED'
                 WHEN declared < 3 THEN 'CANDIDATE_EVENT_INVALID' WHEN key <> object_id THEN 'CANDIDATE_KEY_MISMATCH' END AS error_code,
            CASE WHEN user_id % 43 = 0 THEN 'value' WHEN event_type = 3 THEN 'event_type' WHEN declared < 3 THEN 'eligible_epoch_count' WHEN key <> object_id THEN 'key' END AS error_field
  FROM cand)"""
)

SQL_COMMANDS = (
    SQL_CANDIDATES
    + f""",
cmd AS (SELECT *, {sql_job_id("object_id", "light_curve_revision", chr(39) + BUNDLE + chr(39), EXECUTION_MODES["PRODUCTION"])} AS job_id FROM judged WHERE error_code IS NULL)"""
)

SQL_STATUS = (
    SQL_COMMANDS
    + """,
marks AS (
  SELECT object_id, light_curve_revision, count(*) AS actual_count, count(DISTINCT observation_time) AS times,
         min(CASE WHEN NOT magnitude_error > 0 THEN epoch_index END) AS bad
  FROM flat GROUP BY ALL),
checked AS (
  SELECT cmd.*, actual_count, CASE WHEN declared <> n OR n <> actual_count THEN 'EPOCH_COUNT_MISMATCH' WHEN actual_count < 3 THEN 'TOO_FEW_EPOCHS' WHEN actual_count > 1024 THEN 'TOO_MANY_EPOCHS'
         WHEN bad IS NOT NULL THEN 'BAD_MAGNITUDE_ERROR' WHEN times < actual_count THEN 'DUPLICATE_TIME' END AS cause
  FROM cmd JOIN marks USING (object_id, light_curve_revision))"""
)

#: Modes one after the other, by recursion over revisions: an oracle of another make than the two windows.
SQL_MODES = (
    SQL_STATUS
    + f""",
ok AS (SELECT *, {sql_run_id("job_id")} AS run_id, row_number() OVER (PARTITION BY object_id ORDER BY light_curve_revision) AS k FROM checked WHERE cause IS NULL),
walk AS (
  WITH RECURSIVE w AS (
    SELECT object_id, k, light_curve_revision, n, run_id, CASE WHEN n <= 20 THEN 'COMPUTE_CURRENT' ELSE 'COMPUTE_BOOTSTRAP' END AS mode,
           light_curve_revision AS last_revision, n AS last_n, run_id AS last_run, NULL::BIGINT AS source_revision, NULL::BIGINT AS source_n, NULL::VARCHAR AS source_run
    FROM ok WHERE k = 1
    UNION ALL
    SELECT o.object_id, o.k, o.light_curve_revision, o.n, o.run_id, CASE WHEN o.n <= 20 THEN 'COMPUTE_CURRENT' ELSE 'REUSE_PREVIOUS' END,
           CASE WHEN o.n <= 20 THEN o.light_curve_revision ELSE w.last_revision END, CASE WHEN o.n <= 20 THEN o.n ELSE w.last_n END, CASE WHEN o.n <= 20 THEN o.run_id ELSE w.last_run END,
           CASE WHEN o.n > 20 THEN w.last_revision END, CASE WHEN o.n > 20 THEN w.last_n END, CASE WHEN o.n > 20 THEN w.last_run END
    FROM w JOIN ok o ON o.object_id = w.object_id AND o.k = w.k + 1)
  SELECT * FROM w),
modes AS (SELECT ok.*, walk.mode, source_revision, source_n, source_run, coalesce(source_revision, ok.light_curve_revision) AS coarse_revision FROM ok JOIN walk USING (run_id))"""
)
