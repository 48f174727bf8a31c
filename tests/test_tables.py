"""The run store: what a crash leaves, what a batch reads of a long history, how an object's history is laid out."""

from __future__ import annotations

import os
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumispark.functions.identity import job_id, run_id
from lumispark.operators import runs as R
from lumispark.schemas import RUN
from lumispark.sources.tables import RunStore


def some_runs(spark, n, revisions=1, first=0):
    """n objects with some revisions each, as sound runs with their arrival."""
    rows = spark.range(first, first + n).withColumn("light_curve_revision", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(revisions).cast("long"))))
    rows = rows.select(F.format_string("OBJ-%06d", "id").alias("object_id"), "light_curve_revision", F.lit(0).alias("partition"), (F.col("id") * 100 + F.col("light_curve_revision")).alias("offset"))
    rows = rows.withColumn("job_id", job_id(F.col("object_id"), F.col("light_curve_revision"), F.lit("b"), F.lit(1))).withColumn("run_id", run_id(F.col("job_id")))
    given = {"execution_mode": F.lit(1), "xgboost_executed": F.lit(True), "model_bundle_version": F.lit("b"), "completed_at": F.timestamp_seconds(F.col("offset"))}
    rows = rows.withColumns(given)
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN), "partition", "offset")


def save(store, rows, stream, batch, stop=None):
    """A batch as the result stream stores it, as far as ``stop``."""
    before = store.commit()
    pointers = store.current(before).drop("bucket")
    saved = R.save_outcomes(rows, store.known(rows, before), pointers).where("inserted").select(*rows.columns).cache()
    store.append(saved, stream, batch)
    if stop == "runs":
        return
    places = store.put_current(R.merge_current(pointers, R.current_pointers(saved)), before)
    if stop == "current":
        return
    store.publish(replace(before, version=before.version + 1, streams=before.streams | {stream: (before.streams.get(stream, (-1, -1))[0], batch)}, places=before.places | places))


def pointers(store):
    return {r["object_id"]: r["light_curve_revision"] for r in store.current().collect()}


@pytest.mark.parametrize("stop", ["runs", "current"])
def test_nothing_is_seen_of_a_crashed_batch_and_nothing_is_lost(spark, tmp_path, stop):
    store = RunStore(spark, f"{tmp_path}/store", 2)
    assert store.runs().count() == 0 and pointers(store) == {} and store.known(some_runs(spark, 2), store.commit()).count() == 0
    save(store, some_runs(spark, 8), "a", 0)
    save(store, some_runs(spark, 8, 2), "a", 1)
    was = pointers(store)
    assert len(was) == 8 and set(was.values()) == {2}
    save(store, some_runs(spark, 12, 3), "a", 2, stop)
    # half of what the crashed batch has written is gone, and of the commit that it may have begun
    now = store.commit()
    for b, at in now.places.items():
        for other in {0, 1} - {at}:
            shutil.rmtree(f"{tmp_path}/store/current/bucket={b}/slot={other}", ignore_errors=True)
    shutil.rmtree(f"{tmp_path}/store/commits/slot={(now.version + 1) % 2}", ignore_errors=True)
    assert pointers(store) == was and store.runs().count() == 16
    # another stream replays a part and more in between; then the crashed batch runs again and finds less to insert
    save(store, some_runs(spark, 10, 3), "b", 0)
    save(store, some_runs(spark, 12, 3), "a", 2)
    assert pointers(store) == {f"OBJ-{i:06d}": 3 for i in range(12)}
    assert store.runs().count() == 36 == store.runs().select("run_id").distinct().count()


def test_compaction_keeps_everything_and_crashes_harmlessly(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/store", 2)
    for n in range(3):
        save(store, some_runs(spark, 4, n + 1), "a", n)
        if n:
            publish, store.publish = store.publish, lambda commit: None
            store.compact()  # which stops before its commit
            store.publish = publish
            store.compact()
        assert store.runs().count() == 4 * (n + 1) == store.runs().select("run_id").distinct().count()
        assert store.ids().count() == 8 * (n + 1)
        assert set(pointers(store).values()) == {n + 1}
    known = store.known(some_runs(spark, 5, 4), store.commit())
    assert known.count() == 12 == store.known(some_runs(spark, 5, 4), store.commit(), named=3).count()


def scanned(df):
    """(files, rows) that the scans of a plan have read; a row group that is passed over gives no rows."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), [0, 0]

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found[0] += node.metrics().apply("numFiles").value()
            found[1] += node.metrics().apply("numOutputRows").value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return tuple(found)


def test_a_batch_reads_as_much_of_a_history_ten_times_as_long(spark, tmp_path, monkeypatch):
    from lumispark.sources import tables

    monkeypatch.setattr(tables, "SLICES", 4)
    monkeypatch.setitem(tables.IDS_LAYOUT, "parquet.block.size", "65536")
    batch = some_runs(spark, 5, 1, first=20).cache()  # of which none is stored twice, and some once
    read = {}
    for n in (20_000, 200_000):
        store = RunStore(spark, f"{tmp_path}/{n}", 4)
        save(store, some_runs(spark, n), "a", 0)
        store.compact()
        known = store.known(batch, store.commit())
        read[n] = scanned(known)
        assert known.count() == 5
    (files, rows), (files_then, rows_then) = read.values()
    assert files_then <= files <= 4 and rows_then <= 1.5 * rows and rows_then < 0.2 * 400_000, read


def test_history_of_an_object_reads_one_file_of_its_bucket(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/store", 4)
    for n in range(3):
        save(store, some_runs(spark, 50, n + 1), "a", n)
    store.compact()
    history = store.history("OBJ-000007")
    assert [r["light_curve_revision"] for r in history.collect()] == [3, 2, 1]
    assert scanned(history)[0] == 1
    of = store.runs_of(spark.createDataFrame([("OBJ-000007",), ("OBJ-000008",), ("OBJ-none",)], "object_id string"))
    assert sorted(r["object_id"] for r in of.collect()) == ["OBJ-000007"] * 3 + ["OBJ-000008"] * 3
    every = store.runs_of(store.runs().select("object_id"), named=2)
    assert every.count() == 150
    one = [f for d, _, fs in os.walk(f"{tmp_path}/store/runs/stream=compacted") for f in fs if f.endswith(".parquet")]
    assert len(one) == 4


def test_lookups_in_a_saved_history_do_not_shuffle_it(spark, tmp_path):
    from lumispark.operators import modes
    from lumispark.sources.tables import save_history

    stored = some_runs(spark, 60, 5).withColumn("persisted_at", F.col("completed_at")).withColumn("effective_epoch_count", F.lit(9).cast("long"))
    stored = stored.withColumn("model_bundle_version", F.when(F.col("offset") % 4 == 0, "c").otherwise("b")).withColumn("xgboost_executed", F.col("offset") % 7 > 0)
    history = save_history(stored, "history_of_a_test", f"{tmp_path}/history", 4)
    probes = stored.select(*modes.PAIR, "light_curve_revision", F.lit("kept").alias("other")).union(spark.createDataFrame([("nobody", "b", 3, "kept")], "a string, b string, c long, d string"))
    found = modes.as_of_stored(probes.unionByName(probes.limit(3)), history, 4)
    want = modes.as_of(probes.unionByName(probes.limit(3)), stored)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))

    def above(node, exchanged=False):
        """Whether a shuffle stands between the scan of the history and the join that it goes into."""
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return above(node.executedPlan(), exchanged)
        if name.endswith("QueryStage"):
            return above(node.plan(), exchanged)
        if name.startswith("Scan parquet") and "history_of_a_test" in name:
            return [exchanged]
        children = node.children()
        return [x for i in range(children.size()) for x in above(children.apply(i), "Join" not in name and (exchanged or "Exchange" in name))]

    assert above(found._jdf.queryExecution().executedPlan()) == [False]
    spark.sql("DROP TABLE history_of_a_test")
