"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled, are one stream of words, cut into blocks of equal size. A schedule of slots maps the
golden-ratio sequence through the cumulative weights: a slot belongs to the source into whose interval its point falls,
and the slots of a source, by rank, read its blocks in turn and begin anew when the stream ends. Any stretch of the
schedule has the sources near their weights, so the mix is even from beginning to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.common import cut, lean, table, word_count

#: Words of a block; slots that one task makes at once; documents that are put in order at once.
BLOCK, CHUNK, ORDERED = 64, 1 << 16, 512
#: Points are multiples of 2^31 / golden ratio, modulo 2^31: whole numbers, so that reruns agree.
PERIOD, GOLDEN = 1 << 31, 1_327_217_885
#: Sources up to which their table is broadcast; beyond it is joined by shuffles.
FEW = 100_000


def targets(sizes: list[int], most: float = 3.0) -> list[float]:
    """Words for each source: weights 1, 2, 3, repeating, share all words; none gets over ``most`` times its size, and
    what it cannot take goes to the others by weight, until none is above."""
    weight = [i % 3 + 1 for i in range(len(sizes))]
    got, free, left = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}, float(sum(sizes))
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if unit * weight[i] > most * sizes[i]}
        for i in over or free:
            got[i] = float(most * sizes[i]) if over else unit * weight[i]
        left -= sum(got[i] for i in over)
        free = free - over if over else set()
    return got


def schedule(spark: SparkSession, wanted: list[float]) -> DataFrame:
    """(slot, source_no, rank): slots so many that source i has about wanted[i] of them; rank counts a source's slots from 0.

    Points are made in chunks. A first pass counts each chunk's slots by source; running sums over chunks give the rank
    that each chunk begins with; a second pass makes the same points again and ranks them."""
    n = round(sum(wanted))
    edges = np.array(list(accumulate(wanted))) / (sum(wanted) or 1)
    last = max((i for i, w in enumerate(wanted) if w), default=0)

    def sources(chunk: int) -> np.ndarray:
        i = np.arange(chunk * CHUNK + 1, min((chunk + 1) * CHUNK, n) + 1, dtype=np.int64) % PERIOD
        return np.minimum(np.searchsorted(edges, (i * GOLDEN % PERIOD) / PERIOD, side="right"), last)

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                have = np.bincount(sources(c), minlength=1)
                yield pd.DataFrame({"chunk": c, "source_no": np.flatnonzero(have), "slots": have[have > 0]})

    @lean
    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, begins in zip(b["chunk"], b["begins"], strict=True):
                own = sources(c)
                order = np.argsort(own, kind="stable")
                ranks = np.empty(len(own), dtype=np.int64)
                first = np.searchsorted(own[order], own[order])
                ranks[order] = np.arange(len(own)) - first
                base = {x["source_no"]: x["begin"] for x in begins}
                begin = np.zeros(max(base) + 1, dtype=np.int64)
                begin[list(base)] = list(base.values())
                ranks += begin[own]
                yield pd.DataFrame({"slot": np.arange(len(own), dtype=np.int64) + c * CHUNK, "source_no": own, "rank": ranks})

    chunks = spark.range(-(-n // CHUNK))
    counts = cut(chunks.mapInPandas(count, "chunk long, source_no int, slots long"))
    running = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("slots").over(running), F.lit(0)))
    begins = begins.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "begin")).alias("begins"))
    return begins.mapInPandas(rank, "slot long, source_no int, rank long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents, placements).

    documents: row, id_col, source_col, size (words), source_size, target. One for each row of docs; ``row`` numbers them.
    placements: row, slot, pass, start, length: slot's share of the document, words start to start + length, as its
    source's stream is read for the time ``pass`` (0, 1, 2: no document is taken more than ``most`` times).

    Sources go by code point, a null source last, one of its own. Null and empty texts have no words and are never
    placed. A source without words has target 0. Repeated rows are documents of their own; order among equal rows is
    that of the input. A source's placed words differ from its target by a few blocks. An empty table gives two.
    Source totals are collected (a row a source). A hot source is ordered and cut in buckets of about ORDERED documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(source_col), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    totals = rows.groupBy(source_col).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    totals = sorted(totals, key=lambda r: (r[source_col] is None, r[source_col] or ""))
    sizes = [r["n"] for r in totals]
    want = targets(sizes, most)
    blocks = [-(-n // block) for n in sizes]
    slots = [w * b / n if n else 0.0 for w, b, n in zip(want, blocks, sizes, strict=True)]
    listed = [(r[source_col], i, n, w, max(1, b), n // max(1, b), n % max(1, b)) for i, (r, n, w, b) in enumerate(zip(totals, sizes, want, blocks, strict=True))]
    # as an Arrow table: for a list Spark would start Python workers of another kind, which then stay beside those of Arrow
    kinds = {"name": pa.string(), "source_no": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "blocks": pa.int64(), "short": pa.int64(), "longer": pa.int64()}
    names = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in listed], type=kind) for i, (c, kind) in enumerate(kinds.items())}))
    names = F.broadcast(names) if len(listed) <= FEW else names
    rows = rows.join(names, rows[source_col].eqNullSafe(names["name"])).drop("name")

    # where each document begins in its source's stream: buckets by hash, running sums over buckets and within them
    buckets = max(1, -(-sum(r["rows"] for r in totals) // ORDERED))
    some = rows.where("size > 0").withColumn("h", F.xxhash64(id_col, "size", F.lit("order"))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = some.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    some = some.withColumn("end", F.sum("size").over(within)).join(base, ["source_no", "bucket"])
    some = some.select("row", "source_no", "blocks", "short", "longer", (F.col("base") + F.col("end") - F.col("size")).alias("begin"), (F.col("base") + F.col("end")).alias("end"))

    # the first ``longer`` blocks of a source hold short + 1 words, the others short
    edge = F.col("longer") * (F.col("short") + 1)
    at = lambda p: F.when(p < edge, F.floor(p / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((p - edge) / F.col("short")))
    starts = lambda b: b * F.col("short") + F.least(b, F.col("longer"))
    cells = some.withColumn("block", F.explode(F.sequence(at(F.col("begin")), at(F.col("end") - 1))))
    low = F.greatest("begin", starts(F.col("block")))
    high = F.least("end", starts(F.col("block") + 1))
    cells = cells.select("source_no", "block", "row", (low - F.col("begin")).alias("start"), (high - low).alias("length"))

    ranked = schedule(spark, slots).join(F.broadcast(names.select("source_no", "blocks")) if len(listed) <= FEW else names.select("source_no", "blocks"), "source_no")
    ranked = ranked.select("source_no", "slot", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.pmod("rank", "blocks").alias("block")).where(F.col("pass") < most)
    # Spark takes the slots for as few as the chunks that they are made from, and would send them all through the driver
    placed = ranked.hint("merge").join(cells, ["source_no", "block"]).select("row", "slot", "pass", "start", "length")
    return rows.select("row", id_col, source_col, "size", "source_size", "target"), placed


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents: a row for each pass in which a document is taken, its text cut to the words that are taken.

    Whole texts stay as they are; the few that a source's last block cuts keep their first words, space-joined. Rows are
    numbered once, in a materialised table: numbers made anew by another job depend on how files are split there."""
    docs = docs.withColumn("__row", F.monotonically_increasing_id())
    docs = cut(docs.withColumn("__words", word_count(F.col(text_col))))
    rows, placed = mix(docs, "__row", source_col, text_col)
    parts = placed.groupBy("row", "pass").agg(F.sum("length").alias("__n"), F.min("start").alias("__from"))
    parts = parts.join(rows.select("row", "__row"), "row").drop("row")
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.array_join(F.slice(words, (F.col("__from") + 1).cast("int"), F.col("__n").cast("int")), " ")
    joined = docs.join(parts, "__row")
    return joined.withColumn(text_col, F.when(F.col("__n") == F.col("__words"), F.col(text_col)).otherwise(cut_text)).drop("__row", "__words", "__n", "__from", "pass")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, placed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = placed.groupBy("row").agg(F.sum("length").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
