"""Keys that hold a share of all records, of keys without bound: a mergeable summary finds them, a second pass counts them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.sources.shared import materialised

#: Candidates up to which they are broadcast: there are 4 / (3 share) of them at most, whatever the records are.
FEW = 100_000


def summaries(records: DataFrame, key: str, counters: int) -> DataFrame:
    """(key, n, missed, records) of each task: up to ``counters`` keys with a count each, at most ``missed`` under their own;
    a key that is absent occurred ``missed`` times at most. ``missed`` and ``records`` stand in a task's first row.

    Counts of a batch are added; when there are too many keys the count of the first one too many is taken off all, which
    takes ``counters`` + 1 records for each one that is missed: no more than records / (counters + 1) are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, missed, seen = None, 0, 0
        for batch in batches:
            seen += len(batch)
            part = pa.table({"key": batch["key"], "n": pa.array(np.ones(len(batch), dtype=np.int64))})
            held = part if held is None else pa.concat_tables([held, part])
            held = held.group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
            if len(held) > counters:
                n = held["n"].to_numpy()
                off = int(np.partition(n, -counters - 1)[-counters - 1])
                missed += off
                held = pa.table({"key": held["key"], "n": pa.array(n - off)}).filter(pa.array(n > off))
        if seen:
            none = pa.table({"key": pa.nulls(1, held["key"].type), "n": pa.array([0], type=pa.int64())})
            held = pa.concat_tables([none, held]).combine_chunks()
            first = np.zeros((2, len(held)), dtype=np.int64)
            first[:, 0] = missed, seen
            yield from pa.table({"key": held["key"], "n": held["n"], "missed": pa.array(first[0]), "records": pa.array(first[1])}).to_batches()

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("key")).mapInArrow(run, f"key {kind}, n long, missed long, records long")


def key_shares(records: DataFrame, key: str, share: float) -> DataFrame:
    """(key, records, share) of every key that has at least ``share`` of all records; a null key is a key.

    Exact: a key of that share is in the merged summaries with a count that is short by what they have missed, a quarter of
    the share at most, so it is a candidate; the others that are have three quarters of it. Candidates are counted in a
    second pass, each task's before the shuffle. All keys together are never shuffled nor held. No records: no rows."""
    parts = materialised(summaries(records, key, int(4 / share) + 1))
    missed, total = parts.agg(F.sum("missed"), F.sum("records")).first()
    least = share * (total or 0)
    few = parts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") + (missed or 0) >= least).where("n > 0").select(F.col("key").alias("candidate"))
    rows = records.select(F.col(key).alias("key")).join(F.broadcast(few) if 4 / (3 * share) <= FEW else few, F.col("key").eqNullSafe(F.col("candidate")), "left_semi")
    counts = rows.groupBy("key").agg(F.count("*").alias("records")).where(F.col("records") >= least)
    return counts.withColumn("share", F.col("records") / F.lit(float(total or 1)))
