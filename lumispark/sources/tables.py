"""The run table (append only), the ids of its runs and the current table (one row an object): Parquet below one folder.

What a batch writes is not seen until it is committed: a commit is one small file with the last batch of each stream, the
place of each bucket of pointers and the generation of the compacted parts. Nothing that a commit names is ever deleted or
written again before the commit after it, so a crash at any point leaves the runs and pointers of the last commit, and the
batch that runs again ends as it would have. One stream writes at a time.

- ``runs``, by (stream, batch, bucket of the object), an object's runs together, newest revision first
- ``ids``, by (stream, batch, slice): job and run ids, sorted, with Bloom filters; slice -1 as written by a batch, and slices
  of the id's hash once compacted
- ``current``, by (bucket, slot): a bucket's pointers are written anew into the slot that is not in use
- ``commits``, by slot, two in turn
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.schemas import RUN

BUCKETS = 64
#: Slices of the compacted ids; ids of a batch up to which it names each to the scan, and not slices alone.
SLICES, NAMED = 64, 512
#: The stream that compacted parts are written under, and the slice of ids that are in no slice yet.
COMPACTED, UNSLICED = "compacted", -1
#: Row groups small enough that one holds few of the ids that a batch does not ask for; filters as small as their ids allow.
IDS_LAYOUT = {"parquet.block.size": str(2 << 20), "parquet.page.row.count.limit": "4096", "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}

ARRIVED = [T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("persisted_at", T.TimestampType())]
STORED = T.StructType([*RUN, *ARRIVED, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
IDS = "kind string, id string, other string, stream string, batch long, slice int"
CURRENT = "object_id string, run_id string, light_curve_revision long, updated_at timestamp, bucket int, slot int"
COMMITS = "version long, kind string, name string, low long, high long, slot int"


def bucket(object_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(object_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Commit:
    """What is there: ``streams`` (name: last batch that is compacted, last batch), ``places`` (bucket: slot of its pointers)
    and the generation of the compacted parts, -1 if there are none."""

    version: int = 0
    streams: dict[str, tuple[int, int]] = field(default_factory=dict)
    places: dict[int, int] = field(default_factory=dict)
    generation: int = -1

    def last(self, stream: str) -> int:
        return self.streams.get(stream, (-1, -1))[1]

    def seen(self) -> Column:
        """Which parts are: conditions on partition columns alone, so that no other part is listed or read."""
        parts = [(F.col("stream") == s) & (F.col("batch") > low) & (F.col("batch") <= high) for s, (low, high) in sorted(self.streams.items())]
        if self.generation >= 0:
            parts.append((F.col("stream") == COMPACTED) & (F.col("batch") == self.generation % 2))
        return functools.reduce(operator.or_, parts, F.lit(False))


def _read(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """The table at path; an empty one where nothing has been written yet."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.schema  # noqa: B018  a client that plans late finds out here
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _part(path: str, stream: str, batch: int) -> str:
    """The folder of a part. It is replaced as a whole, so nothing is left in it of an attempt that crashed."""
    return f"{path}/stream={stream}/batch={batch}"


class RunStore:
    """The tables below a folder. ``buckets`` stays what it was when the folder was first written to."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def commit(self) -> Commit:
        """The last commit; a crash while the next one was written leaves this one. Its rows are as many as buckets and
        streams ever started, whatever the history."""
        rows = _read(self.spark, COMMITS, f"{self.path}/commits").collect()
        version = max((r["version"] for r in rows), default=0)
        rows = [r for r in rows if r["version"] == version]
        streams = {r["name"]: (r["low"], r["high"]) for r in rows if r["kind"] == "stream"}
        places = {int(r["name"]): r["high"] for r in rows if r["kind"] == "bucket"}
        return Commit(version, streams, places, next((r["high"] for r in rows if r["kind"] == "generation"), -1))

    def publish(self, commit: Commit) -> None:
        """Make a commit the last one: one file, which takes the place of the one before the last."""
        n = commit.version
        rows = [(n, "stream", s, low, high) for s, (low, high) in commit.streams.items()]
        rows += [(n, "bucket", str(b), 0, slot) for b, slot in commit.places.items()]
        rows += [(n, "generation", "", 0, commit.generation)]
        df = self.spark.createDataFrame(rows, "version long, kind string, name string, low long, high long").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/commits/slot={n % 2}")

    def runs(self, commit: Commit | None = None) -> DataFrame:
        """All committed runs, with their arrival and the columns of their layout."""
        return _read(self.spark, STORED, f"{self.path}/runs").where((commit or self.commit()).seen())

    def ids(self, commit: Commit | None = None) -> DataFrame:
        return _read(self.spark, IDS, f"{self.path}/ids").where((commit or self.commit()).seen())

    def current(self, commit: Commit | None = None, among: list[int] | None = None) -> DataFrame:
        """Committed pointers, of all buckets or those ``among``."""
        places = (commit or self.commit()).places
        parts = [(F.col("slot") == slot) & F.col("bucket").isin([b for b, at in places.items() if at == slot and (among is None or b in among)]) for slot in (0, 1)]
        return _read(self.spark, CURRENT, f"{self.path}/current").where(parts[0] | parts[1]).drop("slot")

    def runs_of(self, objects: DataFrame, commit: Commit | None = None, named: int = NAMED) -> DataFrame:
        """Committed runs of some objects (object_id): the buckets that they are in, and of these, if they are no more than
        ``named``, the row groups that may hold them. Other objects of those buckets are left out by a semi-join."""
        asked = objects.select("object_id").distinct().withColumn("bucket", bucket(F.col("object_id"), self.buckets))
        few = asked.limit(named + 1).collect()
        rows = self.runs(commit)
        if len(few) <= named:
            rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & _any_of("object_id", sorted(r["object_id"] for r in few)))
        else:
            rows = rows.where(F.col("bucket").isin(sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())))
        return rows.join(asked.select("object_id"), "object_id", "left_semi")

    def history(self, object_id: str, commit: Commit | None = None) -> DataFrame:
        """The runs of an object, newest revision first: one bucket's files, and the row groups that may hold the object."""
        of = self.spark.range(1).select(bucket(F.lit(object_id), self.buckets)).first()[0]
        rows = self.runs(commit).where((F.col("bucket") == of) & (F.col("object_id") == object_id))
        return rows.orderBy(F.desc("light_curve_revision"), F.desc("completed_at"), F.desc("run_id"))

    def known(self, incoming: DataFrame, commit: Commit, named: int = NAMED) -> DataFrame:
        """(run_id, job_id) of the committed runs that share a job or run id with incoming ones.

        A batch of up to ``named`` ids names them to the scan, which then reads the row groups that may hold them; a
        larger one reads the slices that its ids are in. Either way what is found is met by an exact join."""
        asked = incoming.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("job", "job_id"), ("run", "run_id"))))).alias("a"))
        asked = asked.select("a.*").distinct().withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
        ids = self.ids(commit)
        few = asked.select("id", "slice").limit(named + 1).collect()
        slices = {r["slice"] for r in few} if len(few) <= named else {r["slice"] for r in asked.select("slice").distinct().collect()}
        ids = ids.where(F.col("slice").isin([UNSLICED, *sorted(slices)]))
        if len(few) <= named:
            ids = ids.where(_any_of("id", sorted(r["id"] for r in few)))
        found = ids.join(asked.select("kind", "id"), ["kind", "id"], "left_semi")
        job = F.col("kind") == "job"
        return found.select(F.when(job, F.col("other")).otherwise(F.col("id")).alias("run_id"), F.when(job, F.col("id")).otherwise(F.col("other")).alias("job_id")).distinct()

    def append(self, runs: DataFrame, stream: str, batch: int) -> None:
        """Runs (with partition and offset) and their ids as parts of their own, which a commit of stream and batch makes seen."""
        self._write_runs(runs.withColumns({"persisted_at": F.current_timestamp(), "bucket": bucket(F.col("object_id"), self.buckets)}), stream, batch)
        pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(a).alias("id"), F.col(b).alias("other")) for k, a, b in (("job", "job_id", "run_id"), ("run", "run_id", "job_id"))))
        rows = runs.select(F.explode(pairs).alias("p")).select("p.*").repartition("id").sortWithinPartitions("id").withColumn("slice", F.lit(UNSLICED))
        self._write_ids(rows, stream, batch)

    def _write_runs(self, runs: DataFrame, stream: str, batch: int) -> None:
        laid = runs.repartition("bucket").sortWithinPartitions("bucket", "object_id", F.desc("light_curve_revision"), F.desc("completed_at"), F.desc("run_id"))
        laid.select(*RUN.names, "partition", "offset", "persisted_at", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_part(f"{self.path}/runs", stream, batch))

    def _write_ids(self, rows: DataFrame, stream: str, batch: int) -> None:
        rows.select("kind", "id", "other", "slice").write.mode("overwrite").options(**IDS_LAYOUT).partitionBy("slice").parquet(_part(f"{self.path}/ids", stream, batch))

    def put_current(self, pointers: DataFrame, commit: Commit) -> dict[int, int]:
        """Write the pointers of some buckets, all that each has, into the slots that commit does not use; their places then."""
        tagged = pointers.withColumn("bucket", bucket(F.col("object_id"), self.buckets)).persist(StorageLevel.MEMORY_AND_DISK)
        places = {r["bucket"]: 1 - commit.places.get(r["bucket"], 1) for r in tagged.select("bucket").distinct().collect()}
        slot = F.when(F.col("bucket").isin([b for b, s in places.items() if s]), 1).otherwise(0)
        tagged.withColumn("slot", slot).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{self.path}/current")
        tagged.unpersist()
        return places

    def compact(self) -> Commit:
        """Write all committed runs and ids into one part each, by bucket and by slice, and commit that in their place. Reads
        that follow open a file for a bucket or a slice. The parts that are compacted remain on disk, unread; the part of
        the compaction before the last is overwritten. Crashing half way leaves everything as it was."""
        now = self.commit()
        part = (now.generation + 1) % 2
        self._write_runs(self.runs(now), COMPACTED, part)
        ids = self.ids(now).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
        self._write_ids(ids.repartition("slice").sortWithinPartitions("slice", "id"), COMPACTED, part)
        then = replace(now, version=now.version + 1, streams={s: (high, high) for s, (_, high) in now.streams.items()}, generation=now.generation + 1)
        self.publish(then)
        return then


def save_history(runs: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Executed runs as a table of the catalogue at path, bucketed by object and bundle and sorted by revision within, a file a
    bucket: lookups meet it without a shuffle (``operators.modes.as_of_stored``). Replaces the table of that name."""
    by = ("object_id", "model_bundle_version")
    rows = runs.where("xgboost_executed").select(*by, "light_curve_revision", "persisted_at", "run_id", "effective_epoch_count", "coarse", "xgboost_executed")
    rows = rows.repartition(buckets, *by).sortWithinPartitions(*by, "light_curve_revision")
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by, "light_curve_revision").saveAsTable(name)
    return runs.sparkSession.table(name)


def _any_of(column: str, values: list[str]) -> Column:
    """The column is one of the values, as equalities: the scan holds each against the statistics and Bloom filter of a row
    group, where of a longer list it would hold only the ends."""
    if len(values) <= 1:
        return F.col(column) == values[0] if values else F.lit(False)
    half = len(values) // 2
    return _any_of(column, values[:half]) | _any_of(column, values[half:])
