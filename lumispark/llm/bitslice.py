"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt to blocks. A block keeps, for each component, a bitmap for each binary digit that is worth its place: the
component less its least value in the block, without its lowest digits. A query's score is added up for all rows of a block
at once, by bitmap arithmetic: each digit of its weights lets the slices of a component into a carry-save adder, shifted.
The sum is read from the most significant slice downward for the k-th value; what the left-out digits could make of a row
bounds who may be among the best, and those rows at the boundary are scored exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.common import cut, lean, table

#: Rows of a block; queries that visit one together; those of them that are added at once.
BLOCK, QUERIES, TOGETHER = 8192, 512, 32
#: Digits that are kept of a component and of a weight.
DIGITS, WEIGHTS = 7, 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

INDEX = "block int, rows int, ids binary, kind string, whole binary, widths binary, slices binary, shift int"
FOUND = pa.schema([("no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vec: Column) -> Column:
    """Not null, all components there and finite."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of rows, as far as every inner product of two of them is sure to fit 64 bits."""
    most = math.isqrt(((1 << 63) - 1) // max(1, x.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * 256.0), -most, most).astype(np.int64)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of words of 64, the last one filled up with zeros."""
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


class Block:
    """Slices of the rows of a block. ``whole``: their whole numbers; ``low``: the least of each component; ``widths``: digits
    of each component above ``low``; ``slices``: bitmaps, component after component, each from digit ``shift`` upwards."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, widths: np.ndarray, slices: np.ndarray, shift: int):
        self.ids, self.whole, self.widths, self.slices, self.shift = ids, whole, widths, slices, shift

    @staticmethod
    def of(ids: np.ndarray, whole: np.ndarray) -> Block:
        above = whole - whole.min(axis=0)
        widths = np.array([int(x).bit_length() for x in above.max(axis=0)], dtype=np.uint8)
        shift = max(0, int(widths.max(initial=0)) - DIGITS)
        bits = [above[:, j] >> s & 1 for j, w in enumerate(widths.tolist()) for s in range(shift, w)]
        return Block(ids, whole, widths, _packed(np.array(bits, dtype=bool).reshape(len(bits), len(ids))), shift)

    def row(self, number: int) -> pa.RecordBatch:
        """A row of INDEX; whole numbers in the narrowest kind that holds them."""
        kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or not self.whole.size or np.iinfo(k).min <= self.whole.min() and self.whole.max() <= np.iinfo(k).max)
        columns = [number, len(self.ids), self.ids.astype("<i8").tobytes(), kind, self.whole.astype(kind).tobytes(), self.widths.tobytes(), self.slices.tobytes(), self.shift]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    @staticmethod
    def read(row: dict) -> Block:
        n, widths = row["rows"], np.frombuffer(row["widths"], dtype=np.uint8)
        whole = np.frombuffer(row["whole"], dtype=row["kind"]).reshape(n, len(widths)).astype(np.int64)
        return Block(np.frombuffer(row["ids"], dtype="<i8"), whole, widths, np.frombuffer(row["slices"], dtype="<u8").reshape(-1, -(-n // 64)), row["shift"])

    def without(self, ids: np.ndarray) -> np.ndarray:
        """For each id a bitmap of the rows that have another."""
        out = np.repeat(_packed(np.ones((1, len(self.ids)), dtype=bool)), len(ids), axis=0)
        for i in np.flatnonzero(np.isin(ids, self.ids)):
            out[i] = _packed((self.ids != ids[i])[None])
        return out

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], list[int], int]:
        """(slices, missing, shift) of scores: for each query (row of weights) and row, 2^shift times the number that the
        slices hold is, but for a constant of the query, at most ``missing`` under the score, and not over it.

        A negative weight counts the complement of a component's slices, so that all that is added is positive."""
        size = np.abs(weights)
        off = max(0, int(size.max(initial=0)).bit_length() - WEIGHTS)
        negative = np.where(weights < 0, ONES, np.uint64(0))
        kept, rest = size >> off, size & ((1 << off) - 1)
        widths = self.widths.tolist()
        low = [(1 << min(self.shift, w)) - 1 for w in widths]  # the most that the digits left out are worth
        most = [(1 << w) - 1 for w in widths]
        missing = [sum((k << off) * a + r * b for k, r, a, b in zip(ks, rs, low, most, strict=True)) for ks, rs in zip(kept.tolist(), rest.tolist(), strict=True)]
        adder, at = Adder(), 0
        for j, w in enumerate(widths):
            digits = [(t, np.where(kept[:, j] >> t & 1, ONES, np.uint64(0))[:, None]) for t in range(int(kept[:, j].max(initial=0)).bit_length())]
            for s in range(max(0, w - self.shift)):
                own = self.slices[at] ^ negative[:, [j]]
                at += 1
                for t, let in digits:
                    adder.add(s + t, own & let)
        return adder.total(), missing, self.shift + off


class Adder:
    """Bitmaps by the power of two that they count. Of three of one power one stays, and one goes to the next."""

    def __init__(self):
        self.held: dict[int, list[np.ndarray]] = defaultdict(list)

    def add(self, power: int, bits: np.ndarray) -> None:
        while True:
            held = self.held[power]
            held.append(bits)
            if len(held) < 3:
                return
            a, b, c = held
            differ = a ^ b
            held[:] = [differ ^ c]
            power, bits = power + 1, (a & b) | (differ & c)

    def total(self) -> list[np.ndarray]:
        """The slices of the sum, least first."""
        out, power = [], 0
        while power <= max(self.held, default=-1):
            held = self.held[power]
            if len(held) == 2:
                a, b = held
                held[:] = [a ^ b]
                self.add(power + 1, a & b)
            out.append(held[0] if held else None)
            power += 1
        blank = np.zeros_like(next(x for x in out if x is not None)) if out else None
        return [blank if x is None else x for x in out]


def kth_value(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th largest value of its rows ``among``, from the most significant slice downward; 0 if there are
    fewer than k."""
    value, above, level = np.zeros(len(among), dtype=np.int64), np.zeros(len(among), dtype=np.int64), among
    for power in reversed(range(len(slices))):
        ones = level & slices[power]
        have = above + np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        enough = have >= k
        value += enough.astype(np.int64) << power
        above = np.where(enough, above, have)
        level = np.where(enough[:, None], ones, level & ~slices[power])
    return np.where(above + np.bitwise_count(level).sum(axis=1, dtype=np.int64) >= k, value, 0)


def at_least(slices: list[np.ndarray], among: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rows ``among`` whose value is each query's or more, as bitmaps."""
    more, level = np.zeros_like(among), among
    for power in reversed(range(len(slices))):
        one = (value >> power & 1).astype(bool)[:, None]
        ones = level & slices[power]
        more = np.where(one, more, more | ones)
        level = np.where(one, ones, level & ~slices[power])
    return more | level


def _visit(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a group of queries does in a block of the index."""

    def visit(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(index) and len(queries):
            block = Block.read(index.to_pylist()[0])
            numbers, ids, weights = queries["no"].to_numpy(), queries["id"].to_numpy(), whole_numbers(_matrix(queries["vec"]))
            for a in range(0, len(ids), TOGETHER):
                asked = weights[a : a + TOGETHER]
                slices, missing, shift = block.sums(asked)
                among = block.without(ids[a : a + TOGETHER])
                least = [max(0, int(v) - (m >> shift)) for v, m in zip(kth_value(slices, among, k), missing, strict=True)]
                rows = at_least(slices, among, np.array(least, dtype=np.int64))
                for i in range(len(asked)):
                    at = np.flatnonzero(np.unpackbits(rows[i].view(np.uint8), bitorder="little"))
                    score = block.whole[at] @ asked[i]
                    best = np.lexsort((block.ids[at], ~score))[:k]
                    n = len(best)
                    out.append(pa.table([np.full(n, numbers[a + i]), np.full(n, ids[a + i]), block.ids[at][best], score[best]], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return visit


def build(vectors: DataFrame, rows: int) -> DataFrame:
    """INDEX of vectors (id, vec: all of one length), a row for each block. Rows are dealt to blocks one by one in turn, so
    that blocks are even whatever the ids and however many copies there are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["id"].to_numpy(zero_copy_only=False), whole_numbers(_matrix(b["vec"]))) for b in batches if len(b)]
        if held:
            yield Block.of(*map(np.concatenate, zip(*held, strict=True))).row(TaskContext.get().partitionId())

    return vectors.repartition(-(-rows // BLOCK)).mapInArrow(run, INDEX)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest score, ties to the smaller id; exact.

    The score is the inner product of the whole numbers floor(256 x) of both. Ids are whole numbers. Vectors that are not
    ``usable`` and rows of a null id take no part; zero vectors do. A query meets vectors of its length only, and no row
    of its own id. Repeated rows are found as often as they are there; queries that agree in id and vector are asked once.
    Fewer rows than k: all of them. No vector or no query: no rows. Extra columns are left out, so none clashes. Components
    so large that a score might leave a long (sqrt(2^63 / d) / 256 of d: 1.4 million of 64) count as the largest that cannot.
    Every query visits every block: pairs of a group of queries and a block are dealt out evenly.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    vectors, queries = clean(vectors), cut(clean(queries).distinct().withColumn("no", F.monotonically_increasing_id()))
    count = lambda df: {r["dim"]: r["n"] for r in df.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    sizes, asked = count(vectors), count(queries)
    found = vectors.sparkSession.createDataFrame([], "no long, query_id long, vec_id long, score long")
    for dim in sorted(sizes.keys() & asked.keys()):
        index = cut(build(vectors.where(F.size("vec") == dim), sizes[dim]))
        groups, blocks = -(-asked[dim] // QUERIES), -(-sizes[dim] // BLOCK)
        left = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = queries.where(F.size("vec") == dim).withColumn("grp", F.pmod(F.xxhash64("no"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = found.unionByName(left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(_visit(k), "no long, query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


SQL_BITSLICE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.a, c.a) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
