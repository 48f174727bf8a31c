"""Operational roll-ups: dead letters, lag, skew, and rules over metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dlq_triage(letters: DataFrame) -> DataFrame:
    """letters (stage, error_code, partition, object_id, offset): counts with first and last offset."""
    keys = ["stage", "error_code", "partition", "object_id"]
    return letters.groupBy(*keys).agg(F.count("*").alias("letters"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def dlq_growth_kind(triage: DataFrame, partitions: int = 2, dominance: float = 0.8) -> DataFrame:
    """By stage: systemic if several partitions grow at once and one code dominates, else isolated. Thresholds are ours."""
    by_code = triage.groupBy("stage", "error_code").agg(F.sum("letters").alias("n"))
    top = by_code.groupBy("stage").agg(F.sum("n").alias("letters"), F.max("n").alias("top"))
    spread = triage.groupBy("stage").agg(F.countDistinct("partition").alias("partitions"), F.countDistinct("object_id").alias("objects"))
    share = F.col("top") / F.col("letters")
    kind = F.when((F.col("partitions") >= partitions) & (share >= dominance), "systemic").otherwise("isolated")
    return top.join(spread, "stage").select("stage", "letters", "partitions", "objects", share.alias("top_share"), kind.alias("kind"))


def lag(offsets: DataFrame) -> DataFrame:
    """Lag by partition, topic and group in one pass; totals have null in the columns they sum over."""
    rows = offsets.withColumn("lag", F.col("end_offset") - F.col("committed_offset"))
    return rows.rollup("group", "topic", "partition").agg(F.sum("lag").alias("lag"))


def key_skew(records: DataFrame, rate: float) -> DataFrame:
    """Records and their share by partition, and the load that a rate of events puts on each."""
    counts = records.groupBy("partition").agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))
    share = F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(0)))  # a row a partition
    return counts.select("partition", "records", "keys", share.alias("share"), (F.lit(rate) * share).alias("offered_load"))


def lag_diagnosis(samples: DataFrame) -> DataFrame:
    """Samples of (group, topic, partition, ts, end_offset, committed_offset) with a diagnosis against the one before:
    stuck if the end grows and the committed offset does not, capacity if both grow and the lag does too, else ok."""
    w = Window.partitionBy("group", "topic", "partition").orderBy("ts")
    more = lambda c: F.col(c) - F.lag(c).over(w)
    rows = samples.withColumn("end_growth", more("end_offset")).withColumn("committed_growth", more("committed_offset"))
    stuck = (F.col("end_growth") > 0) & (F.col("committed_growth") <= 0)
    slow = (F.col("committed_growth") > 0) & (F.col("end_growth") > F.col("committed_growth"))
    return rows.withColumn("diagnosis", F.when(F.col("end_growth").isNull(), "first").when(stuck, "stuck").when(slow, "capacity").otherwise("ok"))


def increases(samples: DataFrame, series: list[str]) -> DataFrame:
    """Counter samples (series, ts, value) with the increase since the one before; a counter that fell began anew from 0."""
    w = Window.partitionBy(*series).orderBy("ts")
    before = F.lag("value").over(w)
    return samples.withColumn("increase", F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def windowed(samples: DataFrame, by: list[str], minutes: int) -> DataFrame:
    """Increase and rate a second by window and labels: combined before the shuffle."""
    start = F.window("ts", f"{minutes} minutes")["start"].alias("window_start")
    return samples.groupBy(start, *by).agg(F.sum("increase").alias("increase"), (F.sum("increase") / (60.0 * minutes)).alias("rate"))


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """The q-quantile of cumulative buckets (by, le, cumulative), linear within a bucket; in the infinite bucket its lower
    bound; null without observations."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("lower", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)))
    rows = rows.withColumn("total", F.max("cumulative").over(Window.partitionBy(*by)))
    rank = F.lit(q) * F.col("total")
    inside = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * (rank - F.col("below")) / (F.col("cumulative") - F.col("below")))
    hit = (F.col("total") > 0) & (F.col("cumulative") >= rank) & (F.col("below") < rank)
    return rows.groupBy(*by).agg(F.min(F.when(hit, inside)).alias("quantile"))


def duration_histogram(durations: DataFrame, by: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative le buckets: one pass of conditional sums, then a row a bucket."""
    sums = durations.groupBy(*by).agg(*(F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate((*bounds, float("inf")))))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate((*bounds, float("inf"))))))
    return sums.select(*by, rows.alias("b")).select(*by, "b.*")


def ratio(top: DataFrame, bottom: DataFrame, on: list[str]) -> DataFrame:
    """Rate over rate on window and labels; null where nothing was counted below."""
    both = top.select(*on, F.col("increase").alias("t")).join(bottom.select(*on, F.col("increase").alias("b")), on)
    return both.select(*on, F.when(F.col("b") > 0, F.col("t") / F.col("b")).alias("mean"))


def held(rows: DataFrame, by: list[str], firing: Column, step_seconds: int, hold: int) -> DataFrame:
    """rows with ``alert``: firing for ``hold`` windows one after the other; a missing window breaks the run."""
    at = F.unix_timestamp("window_start")
    rows = rows.withColumn("firing", firing)
    group = F.when(F.col("firing"), F.floor(at / step_seconds) - F.row_number().over(Window.partitionBy(*by, "firing").orderBy("window_start")))
    rows = rows.withColumn("island", group)
    run = F.row_number().over(Window.partitionBy(*by, "island").orderBy("window_start"))
    return rows.withColumn("alert", F.col("firing") & (run >= hold)).drop("island")


def error_ratio(requests: DataFrame, by: list[str], minutes: int = 5, share: float = 0.05, least: float = 0.1, hold: int = 2) -> DataFrame:
    """requests (ts, by, status class, increase): alert if 5xx are over ``share`` of the traffic and traffic is over ``least``
    a second, for ``hold`` windows. The denominator is 0.001 at least."""
    start = F.window("ts", f"{minutes} minutes")["start"].alias("window_start")
    sums = requests.groupBy(start, *by).agg((F.sum("increase") / (60.0 * minutes)).alias("rate"), (F.sum(F.when(F.col("status_class") == "5xx", F.col("increase")).otherwise(0.0)) / (60.0 * minutes)).alias("errors"))
    sums = sums.withColumn("ratio", F.col("errors") / F.greatest("rate", F.lit(0.001)))
    return held(sums, by, (F.col("ratio") > share) & (F.col("rate") > least), 60 * minutes, hold)


def new_series(windows: DataFrame, by: list[str], minutes: int = 5) -> DataFrame:
    """Windows in which a series counts an event: it increased, or it is there and was not ``minutes`` ago."""
    before = windows.select(*by, (F.col("window_start") + F.expr(f"interval {minutes} minutes")).alias("window_start")).withColumn("was", F.lit(True))
    rows = windows.join(before, [*by, "window_start"], "left").withColumn("is_new", F.col("was").isNull()).drop("was")
    return rows.where("is_new or increase > 0")


def stuck_retry(gauges: DataFrame, seconds: float = 60.0) -> DataFrame:
    """gauges (pod, name, value): pods whose greatest command age is over the limit while something is retrying."""
    age = gauges.where("name = 'command_age_seconds'").groupBy("pod").agg(F.max("value").alias("age"))
    retrying = gauges.where("name = 'commands_retrying'").groupBy("pod").agg(F.max("value").alias("retrying"))
    return age.where(F.col("age") > seconds).join(retrying.where("retrying > 0"), "pod")


def failure_increase(failures: DataFrame, expected: list[tuple[str, ...]], by: list[str], minutes: int = 5) -> DataFrame:
    """Increase of each expected label set in each window that has samples at all; none counts 0.

    A 0 for each expected set is put beside every window's samples before they are summed, so nothing is joined."""
    start = F.window("ts", f"{minutes} minutes")["start"].alias("window_start")
    zeros = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(by, values, strict=True))) for values in expected))
    none = failures.select(start).distinct().select("window_start", F.explode(zeros).alias("z")).select("window_start", "z.*", F.lit(0.0).alias("increase"))
    rows = failures.select(start, *by, "increase").unionByName(none)
    return rows.groupBy("window_start", *by).agg(F.sum("increase").alias("increase"))


def funnel(**stages: DataFrame) -> DataFrame:
    """How far each job came: one row a set of stages reached, with its number of jobs. Full-outer in effect, by one union
    and two partial aggregates, so that no pair of stages is joined."""
    rows = None
    for name, jobs in stages.items():
        part = jobs.select("job_id", F.lit(name).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    reached = rows.groupBy("job_id").agg(*(F.max((F.col("stage") == s).cast("int")).alias(s) for s in stages))
    return reached.groupBy(*stages).agg(F.count("*").alias("jobs"))
