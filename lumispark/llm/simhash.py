"""SimHash near duplicates: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts.

``dedup`` links all fingerprints within a small radius. They are dealt to cells by their population counts. Two that
differ in at most ``radius`` bits cannot have population counts that differ by more, so only tiles of cells within that
distance are compared, and all of those are: no link is lost.

``similar_classes`` links texts by the similarity of their sets of shingles, which needs a radius that no population
count can tell apart. There only texts that share one of the first shingles of their sets are compared (two sets of
the threshold's similarity must), tile by tile, and candidates are checked on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.llm.common import components, cut, lean, slices, split_words, table

SEED = 42
#: Fingerprints of one tile at most; a larger cell has several tiles.
TILE = 8192
#: Rows of one tile that are compared with the other tile at once: 128 x 8192 words are 8 MB.
STRIPE = 128
#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
#: Odd factor of the polynomial of word hashes.
FACTOR = 0xC2B2AE3D27D4EB4F
#: Share of all shingles from which one is common, and the least count for it; shingles that are counted at once.
COMMON, LEAST, WINDOW = 1 / 100_000, 64, 1 << 20
#: Blocks of so many rows are compared all at once; sets of so many shingles whatever their fingerprints are.
SMALL, SHORT = 64, 20
#: Sets, and shingles, of one tile of a family at most, or so.
MEMBERS, SHINGLES = 512, 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; both steps are ASCII only on bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, space-joined, repeats included; of fewer words the whole sequence; of none nothing.

    Every shingle is a slice of the joined words, so its words are not joined one by one."""
    n = len(words)
    if n <= k:
        return [b" ".join(words)] if n else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    return [whole[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def hashes(pieces: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in pieces), dtype=np.uint64, count=len(pieces))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes. None: 0."""
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # so that a very long text needs 4 MB at a time
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str = "text", k: int = 3) -> DataFrame:
    """(id_col, fp): the 64-bit fingerprint of each text's k-word shingles. Null and empty texts have no shingle: all bits 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(majority(hashes(shingles(words_of(t.as_py()), k)))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64())], names=[id_col, "fp"])

    keep = docs.select(id_col, text_col)
    return keep.mapInArrow(run, T.StructType([keep.schema[0], T.StructField("fp", T.LongType())]))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (nodes, smallest node of the part of each) of links a-b among n nodes, by vectorised minimum labels."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _near(fa: np.ndarray, fb: np.ndarray, radius: int, upper: bool, pops: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of pairs within the radius, their distances), a stripe of fa at a time; upper: only pairs i < j of one tile.

    pops: ascending population counts of both; a stripe skips what is out of its reach by them."""
    for i in range(0, len(fa), STRIPE):
        low, high = 0, len(fb)
        if pops:
            low = np.searchsorted(pops[1], int(pops[0][i]) - radius)
            high = np.searchsorted(pops[1], int(pops[0][i : i + STRIPE][-1]) + radius, side="right")
        own, all_ = fa[i : i + STRIPE], fb[low:high]
        far = np.bitwise_count(own[:, None, 0] ^ all_[None, :, 0])
        for w in range(1, fa.shape[1]):
            far = far + np.bitwise_count(own[:, None, w] ^ all_[None, :, w])
        x, y = np.nonzero(far <= radius)
        d = far[x, y]
        x, y = x + i, y + low
        if upper:
            x, y, d = x[x < y], y[x < y], d[x < y]
        if len(x):
            yield x, y, d


def near_pairs(nodes: DataFrame, radius: int, parts: int = 4) -> DataFrame:
    """Links (a, b) between nodes (node: bigint, a fingerprint of 64 bits) that differ in at most radius bits.

    Cells: the bits are cut into ``parts`` equal parts; a cell is the vector of their population counts. Cells are
    compared only if their population counts are within reach. Cells have tiles of TILE nodes at most. A pair of tiles
    gives a spanning forest of its links, at most a link for each node: components come out right, and a group of near
    copies costs no square.
    """
    size = 64 // parts
    cell = [F.bit_count(F.shiftrightunsigned("node", i * size).bitwiseAND((1 << size) - 1)).cast("int") for i in range(parts)]
    nodes = cut(nodes.select("node", F.array(*cell).alias("cell")))
    counts = nodes.groupBy("cell").count().withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
    tiled = nodes.join(counts, "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = cut(tiled.groupBy("cell", "tile").agg(F.collect_list("node").alias("rows")).withColumn("id", F.struct("cell", "tile")))
    span = range(-radius, radius + 1)
    offsets = [o for o in product(span, repeat=parts) if sum(map(abs, o)) <= radius and o >= (0,) * parts]  # each pair of cells once
    shifted = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets)))
    ids = tiles.select("id", "cell", "tile")
    left = ids.select(F.col("id").alias("ia"), F.col("cell").alias("ca"), F.col("tile").alias("ta"), shifted.alias("o"))
    left = left.withColumn("cell", F.zip_with("ca", "o", lambda x, y: x + y))
    pairs = left.join(ids.select("cell", F.col("id").alias("ib"), F.col("tile").alias("tb")), "cell").where("ca <> cell or ta <= tb").select("ia", "ib")
    both = pairs.join(tiles.select(F.col("id").alias("ia"), F.col("rows").alias("ra")), "ia").join(tiles.select(F.col("id").alias("ib"), F.col("rows").alias("rb")), "ib")
    both = both.select((F.col("ia") == F.col("ib")).alias("same"), "ra", F.when(F.col("ia") != F.col("ib"), F.col("rb")).alias("rb"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                a = batch.column(1)[i].values.to_numpy()
                b = a if same else batch.column(2)[i].values.to_numpy()
                names, shift = (a, 0) if same else (np.concatenate((a, b)), len(a))
                xs, ys = [], []
                for x, y, _ in _near(a.view(np.uint64)[:, None], b.view(np.uint64)[:, None], radius, same):
                    x, y = _forest(x, y + shift, len(names))  # at most a link for each node from each stripe
                    xs.append(x)
                    ys.append(y)
                if xs:
                    x, y = _forest(np.concatenate(xs), np.concatenate(ys), len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id): fingerprints of k-word shingles linked within the radius, and the smallest id reachable.

    One row for each row of docs. Null and empty texts have fingerprint 0, which links like any other. Equal
    fingerprints are one node, so copies cost one row in all joins but the last, which Spark splits where it is skewed.
    Null ids take part; they are never the smallest. Extra columns are left out; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(fingerprints(rows, "id", "text", k).withColumnRenamed("fp", "node"))
    least = found.groupBy("node").agg(F.min("id").alias("least"))
    roots = components(near_pairs(least.select("node"), radius))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id")
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return found.join(named, "node").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, scattered so that every bit depends on all (modulo 2^64 throughout)."""
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def coded(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of the k words from there on, edges of texts): all words of all texts, A-Z in lower case.

    A shingle's hash is a polynomial of its words' hashes, so that all are made at once. Those that run over the end of a
    text, or of the last one, are void."""
    names, at, counts = split_words(texts, lower=True)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w.as_buffer(), SEED) for w in names), dtype=np.uint64, count=len(names))[at]
    runs = np.zeros(len(words), dtype=np.uint64)
    for i in range(min(k, len(words))):
        runs[: len(words) - i] = runs[: len(words) - i] * np.uint64(FACTOR) + words[i:]
    return words, _mixed(runs), np.concatenate(([0], np.cumsum(counts)))


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of its words, ascending distinct hashes of its shingles) of each text; of fewer than k words the whole sequence."""
    for low, high in slices(texts, SLICE):
        words, runs, edges = coded(texts.slice(low, high - low), k)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= k:
                yield words[a:b], np.unique(runs[a : b - k + 1])
            else:
                yield words[a:b], _mixed(np.array([xxhash.xxh64_intdigest(words[a:b].tobytes(), SEED)] if b > a else [], dtype=np.uint64))


def same_words(words: np.ndarray) -> bytes:
    """A hash of a sequence of words: 16 bytes."""
    return xxhash.xxh3_128_digest(words.tobytes())


def common_shingles(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Ascending hashes of the shingles that make up COMMON of all or more: at most 1/COMMON, whatever the corpus is.

    All shingles of all texts are counted, WINDOW at a time; those that occur once in a window are left out there, so a
    count is short by one a window at most. What is found decides only in which order shingles are looked at."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def out(names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.full(len(names), total))], names=["h", "c", "total"])

        for b in batches:
            for low, high in slices(b.column(0), SLICE):
                _, runs, edges = coded(b.column(0).slice(low, high - low), k)
                held.append(runs[np.arange(len(runs)) + k <= np.repeat(edges[1:], np.diff(edges))])
                size += len(held[-1])
                if size >= WINDOW:
                    names, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield out(names[counts > 1], counts[counts > 1])
                    held, size, total = [], 0, total + size
        total += size
        names, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
        yield out(names[counts > 1], counts[counts > 1])
        yield out(np.zeros(1, dtype=np.uint64), np.zeros(1))  # a task's last row has all that it has seen

    found = cut(docs.select(text_col).mapInArrow(run, "h long, c long, total long"))
    total = found.where("c = 0").agg(F.sum("total")).first()[0] or 0
    often = found.where("c > 0").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(LEAST, COMMON * total))
    return np.sort(often.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, common: np.ndarray) -> DataFrame:
    """(id, same, n, fp, prefix) of each row: a hash of its words, the number of distinct shingles, two words of fingerprint,
    and the first shingles of its set, common ones behind all others. Two sets of the threshold's similarity share one of
    the first, as one would otherwise lack more shingles of the other than it may."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, sizes, fps, firsts = [], [], [], []
            for words, own in sets_of(b.column(1), k):
                n = len(own)
                same.append(same_words(words))
                sizes.append(n)
                fps.append([_signed(majority(own)), _signed(majority(_mixed(own)))])
                if len(common) and n:
                    late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                    own = np.concatenate((own[~late], own[late]))
                firsts.append(own[: n - ceil(threshold * n - 1e-9) + 1].view(np.int64) if n else own.view(np.int64))
            columns = [b.column(0), pa.array(same, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(fps, type=pa.list_(pa.int64())), pa.array(firsts, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "same", "n", "fp", "prefix"])

    keep = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType().add(keep.schema[0]).add("same", T.BinaryType()).add("n", T.LongType()).add("fp", T.ArrayType(T.LongType())).add("prefix", T.ArrayType(T.LongType()))
    return keep.mapInArrow(run, schema)


def _dealt(rows: DataFrame, key: str, tiles: Column) -> DataFrame:
    """rows (key, node, ...) for every pair of tiles (i, j) of their key, sorted by it; a key of one tile is compared with itself.
    side: whether a row is of tile j where i < j."""
    own = F.pmod(F.xxhash64("node", key), F.col("__tiles")).cast("int")
    rows = rows.withColumn("__tiles", tiles.cast("int")).withColumn("__slot", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    rows = rows.withColumn("i", F.least("__slot", "__other")).withColumn("j", F.greatest("__slot", "__other")).withColumn("side", F.col("__slot") > F.col("__other"))
    return rows.drop("__tiles", "__slot", "__other").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "side", "node")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows in runs that part no pair of tiles."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            new = np.zeros(b.num_rows, dtype=bool)
            for c in (key, "i", "j"):
                own = b.column(c).to_numpy()
                new[1:] |= np.diff(own) != 0
                new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != own[0]
            starts = np.flatnonzero(new)
            if len(starts):
                last = int(starts[-1])
                if held or last:
                    yield pa.Table.from_batches([*held, b.slice(0, last)])
                held = [b.slice(last)]
            else:
                held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _arrays(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _edges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each run of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= np.diff(k) != 0
    start = np.flatnonzero(new)
    return start, np.diff(np.concatenate((start, [len(new)])))


def _tile_pairs(at: np.ndarray, side: np.ndarray, itself: bool, fp: np.ndarray, n: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of the candidates of one pair of tiles, rows in order of population count; sets of SHORT shingles
    at most at any distance."""
    pops = np.bitwise_count(fp[at]).sum(axis=1, dtype=np.int64)
    halves = [np.flatnonzero(~side), np.flatnonzero(side)]
    halves = [h[np.argsort(pops[h], kind="stable")] for h in halves]
    one, two = (halves[0], halves[0]) if itself else halves
    for reach, most in ((radius, None), (64 * fp.shape[1], SHORT)):
        x, y = (h[n[at[h]] <= most] if most else h for h in (one, two))
        if len(x) and len(y):
            for i, j, d in _near(fp[at[x]], fp[at[y]], reach, itself, (pops[x], pops[y])):
                yield at[x[i]], at[y[j]], d


def families(shared: DataFrame, facts: DataFrame, radius: int, ratio: float) -> DataFrame:
    """(a, b): nodes of blocks (node, h: a shingle that size nodes share) that candidates hang together by, not yet checked.

    Candidates: nodes of a block whose sizes are within the ratio and whose fingerprints differ in at most radius bits, by
    tiles. Sets of SHORT shingles at most are candidates at any distance: few shingles say little in bits. What comes out
    is a spanning forest of each batch: a row for each node at most, however many candidates there are."""
    rows = shared.join(facts.select("node", F.get("fp", F.lit(0)).alias("f0"), F.get("fp", F.lit(1)).alias("f1"), "n"), "node")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "h"):
            h, i, j, side, node, f0, f1, n = _arrays(t, "h", "i", "j", "side", "node", "f0", "f1", "n")
            fp = np.stack((f0, f1), axis=1).view(np.uint64)
            start, size = _edges(h, i, j)
            names, number = np.unique(node, return_inverse=True)
            got = []

            def found(x: np.ndarray, y: np.ndarray, d: np.ndarray, n=n, got=got, number=number) -> None:
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                ok = (low >= ratio * high - 1e-9) & ((d <= radius) | (high <= SHORT))
                got.append((number[x[ok]], number[y[ok]]))

            # small blocks all at once: each row with the one that is 1, 2, ... behind it
            small = (size <= SMALL) & (i[start] == j[start])
            left = np.repeat(np.where(small, start + size, 0), size) - np.arange(len(h))
            rest = np.flatnonzero(left > 1)
            for step in range(1, SMALL):
                rest = rest[left[rest] > step]
                if not len(rest):
                    break
                found(rest, rest + step, np.bitwise_count(fp[rest] ^ fp[rest + step]).sum(axis=1))
            for a, m in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
                own = []
                for x, y, d in _tile_pairs(np.arange(a, a + m), side[a : a + m], i[a] == j[a], fp, n, radius):
                    found(x, y, d)
                    own.append(_forest(*got.pop(), len(names)))  # at most a link for each node from each stripe
                if own:
                    got.append(tuple(np.concatenate(z) for z in zip(*own, strict=True)))
            if got:
                x, y = _forest(*(np.concatenate(z) for z in zip(*got, strict=True)), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["a", "b"])

    return _dealt(rows, "h", F.ceil(F.col("size") / TILE)).mapInArrow(run, "a long, b long")


def checked(held: DataFrame, radius: int, threshold: float) -> DataFrame:
    """(a, b): nodes of one family (node, set, fp, family, tiles) whose sets have the threshold's similarity.

    By pairs of tiles of a family: candidates by fingerprints, nearest first, are checked on their whole sets where they do
    not hang together yet. So a family costs no row for a pair, near copies cost a check each, and no link is lost: what
    comes out connects all that checked candidates of the two tiles connect."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "family"):
            family, i, j, side, node, f0, f1 = _arrays(t, "family", "i", "j", "side", "node", "f0", "f1")
            fp = np.stack((f0, f1), axis=1).view(np.uint64)
            sets = t.column("set").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            edge, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            n = np.diff(edge)
            links: list[tuple[int, int]] = []
            for a, m in zip(*(z.tolist() for z in _edges(family, i, j)), strict=True):
                got = list(_tile_pairs(np.arange(a, a + m), side[a : a + m], i[a] == j[a], fp, n, radius))
                if not got:
                    continue
                x, y, d = (np.concatenate(z) for z in zip(*got, strict=True))
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                ok = low >= threshold * high - 1e-9
                order = np.argsort(d[ok], kind="stable")
                root = list(range(m))

                def top(k: int, root=root) -> int:
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                for p, q in zip(x[ok][order].tolist(), y[ok][order].tolist(), strict=True):
                    u, v = top(p - a), top(q - a)
                    if u != v:
                        one, two = flat[edge[p] : edge[p + 1]], flat[edge[q] : edge[q + 1]]
                        common = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                        if common >= threshold * (len(one) + len(two) - common) - 1e-9:
                            root[max(u, v)] = min(u, v)
                            links.append((p, q))
            if links:
                p, q = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[p]), pa.array(node[q])], names=["a", "b"])

    return _dealt(held, "family", F.col("tiles")).mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, radius: int = 36) -> DataFrame:
    """(same, first, class_id, stays): the class of each sequence of words; same is its ``same_words``, first.id its smallest id.

    Texts are linked that have sets of k-word shingles of a Jaccard similarity of threshold or more. Blocks: texts that
    share one of the first shingles of their sets, common shingles last (see ``sketches``); no two texts of the threshold's
    similarity are without one, and common passages make no large block unless texts hold little else. In a block tiles
    of 128-bit fingerprints are compared: at similarity 0.8 a pair differs in 19 bits with a deviation of 4. What hangs
    together by candidates is a family; its sets meet once (in pairs of tiles if it is large) and are checked there.
    stays: of each class the sequence with the smallest id (null ids last). Texts without words are one class.
    """
    common = common_shingles(docs, text_col, k)
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    nodes = sketches(docs, id_col, text_col, k, threshold, common).groupBy("same").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    posted = nodes.where("n > 0").select("node", F.explode("prefix").alias("h"))
    shared = posted.withColumn("size", F.count("*").over(Window.partitionBy("h"))).where("size > 1")
    roots = components(families(shared, nodes, radius, threshold))
    family = roots.select("node", F.col("root").alias("family")).union(roots.select("root", "root").distinct())
    family = cut(family.join(nodes.select("node", "same", "first", "fp", "n"), "node"))
    sizes = family.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).alias("tiles"))
    held = _held(docs, family, id_col, text_col, k).join(family.select("node", "family", F.get("fp", F.lit(0)).alias("f0"), F.get("fp", F.lit(1)).alias("f1")), "node").join(sizes, "family")
    roots = components(checked(held, radius, threshold))
    named = nodes.select("node", "same", "first").join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    stays = named.groupBy("class_id").agg(F.min(F.struct("first", "node")).alias("s")).select("class_id", F.col("s.node").alias("kept"))
    return named.join(stays, "class_id").select("same", "first", "class_id", (F.col("node") == F.col("kept")).alias("stays"))


def _held(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, set) of nodes, from the text of their first row. A text is shuffled once, by id and words."""
    ids = nodes.select("node", "same", F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("key"))
    texts = with_hash(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text")), "text", "same")
    texts = texts.join(ids, ["key", "same"]).groupBy("key", "same", "node").agg(F.first("text").alias("text")).select("node", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s.view(np.int64) for _, s in sets_of(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, type=pa.list_(pa.int64()))], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set array<bigint>")


def with_hash(docs: DataFrame, text_col: str = "text", to: str = "__same") -> DataFrame:
    """docs with the ``same_words`` of their text. Row by row; a column of that name is replaced."""
    docs = docs.drop(to)
    schema = T.StructType([*docs.schema, T.StructField(to, T.BinaryType())])
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for low, high in slices(b.column(at), SLICE):
                words, _, edges = coded(b.column(at).slice(low, high - low), 0)
                same += [same_words(words[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, type=pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, radius: int = 36) -> DataFrame:
    """(id_col, same, class_id, keep): the class of each row by ``classes``; rows of equal words are of one class.

    ``keep``: the row is the one of its class that stays, the smallest id (repeated rows of that id and words all are).
    Null and empty texts are one class. Null ids come last. Extra columns are left out; an empty table gives none."""
    found = classes(docs, id_col, text_col, k, threshold, radius)
    rows = with_hash(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "same").select("id", "same")
    return rows.join(found, "same").select(F.col("id").alias(id_col), "same", "class_id", (F.col("stays") & F.col("id").eqNullSafe(F.col("first.id"))).alias("keep"))


def near_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each class of ``classes`` one row, of the smallest id, stays as it is, all columns.

    Texts are shuffled once, by id and words; rows of one id and equal words come together there, and one of them stays."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keep = cut(classes(docs, id_col, text_col, k, threshold).where("stays").select(key(F.col("first.id")).alias("__key"), F.col("same").alias("__same")))
    marked = with_hash(docs, text_col).withColumn("__key", key(F.col(id_col)))
    return marked.join(keep, ["__key", "__same"], "left_semi").dropDuplicates(["__key", "__same"]).drop("__key", "__same")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
