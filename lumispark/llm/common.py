"""What the training-data operators share: reading tables, cutting lineage, components of a link graph."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the Arrow batches that carry texts to Python workers, and the session setting that holds them.
BATCH, BATCH_BYTES = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to the session's Python workers some BATCH bytes at a time, unless the user has set another limit.

    By default a batch is 10,000 rows of up to 64 MB, so a task's whole texts: the JVM builds it in buffers that double as
    they grow, the worker holds it once more. Buffers of that size also stay in the JVM's native heap when they are free.
    How rows are dealt to batches changes no result. It is a setting of the session as Spark reads it when a query runs."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of some ``most`` bytes of text; a longer text is a run by itself or ends one."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    yield from (x for x in zip(edges[:-1], edges[1:], strict=True) if x[0] < x[1])


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, which of them each word of all texts is, number of words of each text); null counts as empty.

    Words are cut and told apart by Arrow, so that Python sees each distinct one once. ``lower``: A-Z in lower case."""
    texts = pc.fill_null(texts, "")
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = found.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, "").as_py()  # white space at an end of a text leaves an empty word
    if blank >= 0:
        keep = at != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        at = at[keep]
    return coded.dictionary, at, counts


def give_back() -> None:
    """Hand memory that is free in this process back to the system: Arrow's, and the C library's if it can (glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(task: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back when it ends. Workers outlive tasks: without that, each idle or busy
    one keeps the height of the hungriest stage that it ever ran, and later stages add theirs. ``forget`` is called before:
    it empties what the task remembered in its module."""

    @functools.wraps(task)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            forget()
            give_back()

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset (tests in one JVM) a temporary one is set; on a cluster that would be a folder of the driver
    alone, so it is refused there.
    """
    context = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Slots:
    """Tables of a loop, written as Parquet in the shared folder and read again. Each name has two places in turn, so that a
    round's table takes the place of the one before the last, and a loop leaves two of each behind however long it runs.

    A checkpoint would do but for its size estimate, which goes on from the plan that it cuts: a join's is the product of
    both sides', so in a loop of joins it doubles its digits each round until the driver does little else."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.turn = spark, f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.turn[name] = 1 - self.turn.get(name, 1)
        path = f"{self.folder}/{name}-{self.turn[name]}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for every node that has one; other nodes are absent.

    Contraction: every node hangs below its smallest smaller neighbour, the trees are flattened by pointer jumping,
    links are renamed to roots, and so on until no link is left. A round at least halves the nodes that still have
    links. All steps are joins and partial aggregates: a hub costs one partial minimum per task, not one task.
    Links that are null on a side, or from a node to itself, are ignored; repeated ones count once. No links: no rows.
    """
    slots = Slots(links.sparkSession)
    links = slots.keep(
        "links",
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
    )
    found = None
    while not links.isEmpty():
        above = slots.keep("above", links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = above.select(F.col("node").alias("root"), F.col("root").alias("up"))
            above = slots.keep("above", above.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
            moved, above = not above.where("moved").isEmpty(), above.drop("moved")
            if not moved:
                break
        named_a = above.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        named_b = above.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        if found is None:
            found = slots.keep("found", above)
        else:
            to = above.select(F.col("node").alias("root"), F.col("root").alias("to"))
            found = slots.keep("found", found.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(above))
        links = slots.keep(
            "links",
            links.join(named_a, "a", "left")
            .join(named_b, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
        )
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
