"""Packing token ids into training sequences: harmonic packing, and best-fit-decreasing packing with binary output.

Both tokenise where a text is read and pack in the same task: no text and no id is shuffled, a task needs the memory of
one slice of texts and its open bins, and a lost task is done again by itself with the same result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumispark.llm.common import lean, slices, table
from lumispark.llm.tokens import default_path, encoder, forget

#: Bytes of text that are tokenised at once.
SLICE = 1_000_000
#: Sequences of one task have ids from this many times its number.
PER_TASK = 1 << 33
#: Token ids that are packed best-fit-decreasing at once.
WINDOW = 1 << 21


#: A task that tokenises: at its end a worker keeps the tokenizer, not its words.
tokenising = functools.partial(lean, forget=forget)


def _tokenised(batch: pa.RecordBatch, text_col: str, path: str, eos: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, its ids with eos behind them), a slice of texts at a time."""
    enc, column = encoder(path), batch.column(batch.schema.get_field_index(text_col))
    for low, high in slices(column, SLICE):
        ids, counts = enc.encode(column.slice(low, high - low))
        ends = np.cumsum(counts)
        own = np.insert(ids, ends, eos)  # behind each text
        last = (ends + np.arange(1, len(ends) + 1)).tolist()
        for row, a, b in zip(range(low, high), [0, *last[:-1]], last, strict=True):
            yield row, own[a:b]


def harmonic_cuts(n: int, capacity: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, then ever smaller halves of one, then what is under ``least``."""
    pieces, at, size = [], 0, capacity
    while n - at >= least and size >= least:
        if n - at >= size:
            pieces.append((at, size))
            at += size
        else:
            size //= 2
    return pieces + [(at, n - at)] if at < n else pieces


class Harmonic:
    """Bins of one worker. A piece of length in (capacity/(k+1), capacity/k] is of class k, whose bins hold k pieces.

    A bin is given out as it fills, so that open bins are all that is held. What is left open at the end is strung
    together, cut into whole sequences, and its rest into sequences that are powers of two and need no padding."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def add(self, piece: tuple) -> list | None:
        """piece: (document, start, ids). The full bin, if this piece fills one."""
        k = self.capacity // len(piece[2])
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.open.pop(k) if len(bin_) == k else None

    def rest(self) -> Iterator[list]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        at, used = 0, 0
        for size in sizes:
            bin_ = []
            while size:
                doc, start, ids = left[at]
                n = min(size, len(ids) - used)
                bin_.append((doc, start + used, ids[used : used + n]))
                size, used = size - n, used + n
                if used == len(ids):
                    at, used = at + 1, 0
            yield bin_


def pack_harmonic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, eos: int = 1, least: int = 64, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id of every document lies in one piece. Pieces of a sequence follow each other without gaps. A sequence that is
    shorter than the capacity (a power of two) is to be padded to it, unless its length is a power of two. Null and empty
    texts have the eos id alone. Repeated rows are documents of their own. Null ids stay null. Extra columns are left
    out. An empty table gives an empty result. ``least``: what is cut off a document is no shorter; the last piece may be.
    """
    path = tokenizer or default_path()
    schema = T.StructType(
        [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    @tokenising
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * PER_TASK
        bins, made = Harmonic(capacity), 0
        kind = pa.int64()

        def rows(full: list[list]) -> pa.RecordBatch:
            nonlocal made
            flat, offsets, names = [], [], []
            for bin_ in full:
                at = 0
                for p in bin_:
                    flat.append(p)
                    offsets.append(at)
                    names.append(base + made)
                    at += len(p[2])
                made += 1
            ids = [np.ascontiguousarray(p[2], dtype="<u4") for p in flat]
            sizes = [len(x) for x in ids]
            columns = [
                pa.array([p[0][0] for p in flat], type=kind),
                pa.array([p[1] for p in flat], type=pa.int64()),
                pa.array(sizes, type=pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], type=pa.int64()),
                pa.array([p[0][1] for p in flat], type=pa.int64()),
                pa.array(names, type=pa.int64()),
                pa.array(offsets, type=pa.int64()),
            ]
            if with_ids:
                ends = np.cumsum([0, *sizes]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(id_col).type
            named = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            full, held = [], 0
            for row, ids in _tokenised(batch, text_col, path, eos):
                for start, n in harmonic_cuts(len(ids), capacity, least):
                    if done := bins.add(((named[row], len(ids)), start, ids[start : start + n].copy())):
                        full.append(done)
                        held += capacity
                        if held >= WINDOW:
                            yield rows(full)
                            full, held = [], 0
            if full:
                yield rows(full)
        if left := list(bins.rest()):
            yield rows(left)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Capacities:
    """Bins by the room that is left in them: a segment tree over room 0..capacity finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i //= 2

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of ``least`` or more; the bin is taken out."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions) of best-fit-decreasing: longest first, each where the least room stays."""
    rooms, bins = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found:
            room, b = found
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rooms.put(room - lengths[i], b)
    return bins


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, eos: int = 49407, pad: int = 0) -> DataFrame:
    """One row for each sequence, a row of the packed id matrix:

    sequence_id; n_tokens, its ids before padding; input_ids, capacity ids as little-endian unsigned 32-bit binary;
    cu_seqlens, cumulative segment lengths from 0; position_resets, for each segment where it begins in the sequence, so
    that positions count from 0 again there; doc_ids and doc_starts, whose ids a segment holds and how many come before it.

    A document of more than capacity ids is split into whole sequences and a rest, without loss. Windows of WINDOW ids
    are packed one after the other in each task: bounded memory, and with some thousand documents a window it fills
    sequences as one over all would. Null and empty texts have the eos id alone; repeated rows are documents of their
    own; null ids stay null; extra columns are left out; an empty table gives none.
    """
    path = tokenizer or default_path()
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    schema = (
        T.StructType()
        .add("sequence_id", long)
        .add("n_tokens", long)
        .add("input_ids", T.BinaryType())
        .add("cu_seqlens", ints)
        .add("position_resets", ints)
        .add("doc_ids", T.ArrayType(docs.schema[id_col].dataType))
        .add("doc_starts", T.ArrayType(long))
    )

    @tokenising
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() * PER_TASK
        # pieces: (document, start, ids); a document's last piece is what best-fit has to place, the others fill a sequence
        whole: list[tuple] = []
        rest: list[tuple] = []

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal made, whole, rest
            bins = [[p] for p in whole] + [[rest[i] for i in b] for b in best_fit([len(p[2]) for p in rest], capacity)]
            flat = [p for b in bins for p in b]
            many = np.array([len(b) for b in bins])
            sizes = np.array([len(p[2]) for p in flat], dtype=np.int64)
            # where each piece goes in a matrix of len(bins) x capacity: behind the pieces before it in its row
            row = np.repeat(np.arange(len(bins)), many)
            before = np.cumsum(sizes) - sizes
            head = np.cumsum(many) - many
            offset = before - before[head][row]
            matrix = np.full(len(bins) * capacity, pad, dtype="<u4")
            for p, at in zip(flat, (row * capacity + offset).tolist(), strict=True):
                matrix[at : at + len(p[2])] = p[2]
            used = np.add.reduceat(sizes, head)
            ends = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
            spans = np.arange(len(bins) + 1, dtype=np.int32) * capacity * 4
            cu = np.insert(offset, np.cumsum(many), used)
            lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at), values)
            columns = [
                pa.array(np.arange(made, made + len(bins), dtype=np.int64)),
                pa.array(used),
                pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(spans), pa.py_buffer(matrix)]),
                lists(pa.array(cu.astype(np.int32)), ends + np.arange(len(bins) + 1, dtype=np.int32)),
                lists(pa.array(offset.astype(np.int32)), ends),
                lists(pa.array([p[0] for p in flat], type=kind), ends),
                lists(pa.array([p[1] for p in flat], type=pa.int64()), ends),
            ]
            made += len(bins)
            whole, rest = [], []
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        held, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field(id_col).type
            named = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            for row, ids in _tokenised(batch, text_col, path, eos):
                n, full = len(ids), len(ids) // capacity * capacity
                whole += [(named[row], start, ids[start : start + capacity]) for start in range(0, full, capacity)]
                if full < n:
                    rest.append((named[row], full, ids[full:]))
                held += n
                if held >= WINDOW:
                    yield flush(kind)
                    held = 0
        if whole or rest:
            yield flush(kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed sequences as Parquet part files: id matrix rows, cumulative lengths and resets side by side."""
    packed.write.parquet(path)


def unpack(row) -> list[tuple]:
    """(doc_id, doc_start, ids) of the segments of one packed row: the round trip."""
    ids = np.frombuffer(row["input_ids"], dtype="<u4")
    edges = row["cu_seqlens"]
    return [(d, s, ids[a:b]) for d, s, a, b in zip(row["doc_ids"], row["doc_starts"], edges[:-1], edges[1:], strict=True)]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_harmonic(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))
