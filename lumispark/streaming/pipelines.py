"""The flow as streams: each batch's effects come before its offsets are committed, and running a batch again changes nothing.

Outputs are folders partitioned by stream (named after its checkpoint) and batch: a batch that is run again overwrites its
own part, and a stream with another checkpoint writes parts of its own. No stream drops duplicates by a watermark: replays can come at any time, so they are told by the run table; and late means a lower revision, not an
earlier time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumispark.operators import candidates as C
from lumispark.operators import commands as M
from lumispark.operators import runs as R
from lumispark.schemas import CANDIDATE, COMMAND, RUN, result_schema
from lumispark.sources.messages import decode
from lumispark.sources.tables import BUCKETS, RunStore, bucket


def stream_name(checkpoint: str) -> str:
    """One name for each checkpoint: batch numbers count within it, and begin anew with another."""
    return hashlib.sha256(checkpoint.encode("utf-8")).hexdigest()[:16]


class RowsLostError(RuntimeError):
    """A batch gave out more or fewer rows than it took in."""


def _write(rows: DataFrame, path: str, stream: str, batch: int) -> int:
    """Write a part; how many rows there were, as counted on their way."""
    seen = Observation()
    tagged = rows.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("stream", F.lit(stream)).withColumn("batch", F.lit(batch).cast("long"))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path)
    return seen.get["rows"]


def _conserved(kind: str, batch: int, came: int, **went: int) -> None:
    """Stop the stream, before the batch is committed, if a row that came went nowhere or to two places."""
    if came != sum(went.values()):
        raise RowsLostError(f"batch {batch} of the {kind} took {came} rows and gave {went}")


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def candidate_stream(envelopes: DataFrame, topic: str, bundle: str, command_topic: str, dlq_topic: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Candidates to ``out``/commands and ``out``/dead_letters: each event gives one of them or, by policy, nothing. A batch
    whose written rows and those passed over are not as many as came is not committed, and the stream stops."""
    name = stream_name(checkpoint)

    def work(batch: DataFrame, n: int) -> None:
        rows = C.validate_candidates(decode(batch, CANDIDATE), topic).persist(StorageLevel.MEMORY_AND_DISK)
        came, passed = rows.agg(F.count("*"), F.count_if(C.passed_over())).first()
        written = _write(C.commands(rows, bundle, command_topic), f"{out}/commands", name, n)
        dead = _write(C.candidate_dead_letters(rows, dlq_topic), f"{out}/dead_letters", name, n)
        _conserved("candidate stream", n, came, commands=written, dead_letters=dead, passed_over=passed)
        rows.unpersist()

    return _start(envelopes, work, checkpoint, once)


def command_stream(envelopes: DataFrame, topic: str, dlq_topic: str, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Commands to ``out``/results, ``out``/dead_letters and ``out``/pending.

    ``process`` takes valid commands (with their envelope) and gives (results, failed); failed has the envelope, ``failure``
    and ``operation``. Permanent failures become dead letters; retryable ones stay pending, and the next batch takes them
    up with its own: that is the retry, without a sleeping task. A stream with a new checkpoint reads the topic again, and
    so has its own pending rows; results have deterministic ids, so what is published twice is stored once. ``process`` has
    to give one result or one failure for each command: a batch that does not is not committed, and the stream stops."""
    name = stream_name(checkpoint)

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            kept = T.StructType([*batch.schema, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
            before = spark.read.schema(kept).parquet(f"{out}/pending")
            rows = batch.unionByName(before.where((F.col("stream") == name) & (F.col("batch") == n - 1)).select(*batch.columns))
        judged = M.validate_commands(decode(rows, COMMAND), topic).persist(StorageLevel.MEMORY_AND_DISK)
        good = judged.where("error is null")
        bad = judged.where("error is not null").withColumn("failure", F.struct(F.lit("PERMANENT").alias("class"), F.col("error.code").alias("code"))).withColumn("operation", F.lit("decode-command"))
        results, failed = process(good)
        columns = [*batch.columns, "failure", "operation"]
        lost = bad.select(*columns).unionByName(failed.select(*columns)).persist(StorageLevel.MEMORY_AND_DISK)
        written = _write(results, f"{out}/results", name, n)
        _conserved("command stream", n, judged.count(), results=written, failed=lost.count())
        _write(M.command_dead_letters(lost, dlq_topic), f"{out}/dead_letters", name, n)
        # written even when there is nothing pending, so that the next batch has a part to read
        _write(lost.where("failure.class = 'RETRYABLE'").select(*batch.columns), f"{out}/pending", name, n)
        lost.unpersist()
        judged.unpersist()

    return _start(envelopes, work, checkpoint, once)


def result_stream(
    envelopes: DataFrame,
    topic: str,
    dlq_topic: str,
    out: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    once: bool = True,
    compact_every: int = 256,
    after: Callable[[str, int], None] = lambda step, batch: None,
) -> StreamingQuery:
    """Results to the run store ``out`` (runs, ids, current pointers) and to ``out``/dead_letters.

    A batch tells its runs from all that are stored, by job and run id, whatever stream and batch those came with; it adds
    its new runs and the pointers of the buckets that it touches, where what is stored stays unless a strictly greater
    revision came, and then commits both at once. Until then nothing of it is seen: a batch that crashes and runs again
    gives what it would have given, one that had been committed does nothing, and a replay from another checkpoint, in
    other batches or of a part of the log inserts nothing that is there. The store is compacted every ``compact_every``
    batches. ``after`` is called after each step (dead_letters, runs, current, commit) with the batch's number.

    The stream is known by its id, which its checkpoint keeps: a checkpoint begun anew is another stream."""
    name = stream_name(checkpoint)

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store, own = RunStore(spark, out, buckets), spark.sparkContext.getLocalProperty("sql.streaming.queryId") or name
        before = store.commit()
        if n <= before.last(own):
            return
        judged = R.validate_results(decode(batch, result_schema()), topic).persist(StorageLevel.MEMORY_AND_DISK)
        dead = _write(R.result_dead_letters(judged, dlq_topic), f"{out}/dead_letters", name, n)
        after("dead_letters", n)
        incoming = judged.where("error is null").select(*RUN.names, "partition", "offset")
        touched = [r[0] for r in incoming.select(bucket(F.col("object_id"), buckets)).distinct().collect()]
        if touched:
            pointers = store.current(before, among=touched).drop("bucket")
            outcomes = R.save_outcomes(incoming, store.known(incoming, before), pointers).persist(StorageLevel.MEMORY_AND_DISK)
            _conserved("result stream", n, judged.count(), dead_letters=dead, outcomes=outcomes.count())
            saved = outcomes.where("inserted").select(*RUN.names, "partition", "offset")
            store.append(saved, own, n)
            after("runs", n)
            places = store.put_current(R.merge_current(pointers, R.current_pointers(saved)), before)
            after("current", n)
            low = before.streams.get(own, (-1, -1))[0]
            store.publish(replace(before, version=before.version + 1, streams=before.streams | {own: (low, n)}, places=before.places | places))
            after("commit", n)
            outcomes.unpersist()
        judged.unpersist()
        if (n + 1) % compact_every == 0:
            store.compact()

    return _start(envelopes, work, checkpoint, once)


def running_current(runs: DataFrame) -> DataFrame:
    """The current revision of each object as keyed state of a stream of PRODUCTION runs (object_id, run_id,
    light_curve_revision): a row whenever it moves. The variant without tables; only strictly greater revisions move it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (0, "")
        moved = False
        for b in batches:
            top = b.loc[b["light_curve_revision"].idxmax()]
            if top["light_curve_revision"] > best[0]:
                best, moved = (int(top["light_curve_revision"]), top["run_id"]), True
        state.update(best)
        if moved:
            yield pd.DataFrame({"object_id": [key[0]], "run_id": [best[1]], "light_curve_revision": [best[0]]})

    out = "object_id string, run_id string, light_curve_revision long"
    return runs.groupBy("object_id").applyInPandasWithState(step, out, "light_curve_revision long, run_id string", "append", GroupStateTimeout.NoTimeout)


def windowed_alerts(samples: DataFrame, width: str, slide: str, late: str, least: float) -> DataFrame:
    """Sliding windows over a stream of increases (ts, service, reason, increase) in which more than ``least`` came; samples
    later than ``late`` are not waited for."""
    windows = samples.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "service", "reason").agg(F.sum("increase").alias("increase"))
    return windows.where(F.col("increase") > least).select(F.col("window.start").alias("window_start"), "service", "reason", "increase")
