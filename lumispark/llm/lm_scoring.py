"""Cross-entropy difference of two n-gram models: how much more a document is like the target than like the background.

Both models are word bigrams with absolute discounting that backs off to smoothed unigrams. They are matched: one
vocabulary (all words), one order, one discount; only the counts differ. The target's are over the documents chosen by a
label, the background's over all others. A document is scored by counts from which its own are taken off.

No count is left out, and none comes to the driver. Documents are dealt to slices; a slice asks for its distinct pairs, dealt
by first word to about as many groups as there are slices; a group adds up what all slices have of a pair and answers each of
them; a slice then scores its documents with what it was answered. What a task holds is about a slice, but for
the group of a very frequent first word: its distinct pairs of every slice meet there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumispark.llm.common import Slots, lean, slices, split_words, table

DISCOUNT = 0.5
#: Bytes of text of a slice; a longer document is one by itself.
SLICE = 4_000_000
#: The edge of a text, as a word's hash. Words go by hashes of 64 bits.
EDGE = np.uint64(1)

ASKED = "grp int, slice long, first binary, many binary, second binary, target binary, background binary"
ANSWERED = "grp int, slice long, words binary, pairs binary, totals array<long>"


def sliced(docs: DataFrame) -> DataFrame:
    """(slice, size, ids, texts): documents (id, text) in rows of some SLICE bytes, where they lie; null texts as empty ones."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            nonlocal number
            part = pa.concat_tables(held).combine_chunks()
            listed = [pa.ListArray.from_arrays(pa.array([0, len(part)], type=pa.int32()), part[c].chunk(0)) for c in ("id", "text")]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([size]), *listed], names=["slice", "size", "ids", "texts"])

        for batch in batches:
            for a, b in slices(batch["text"], SLICE // 8):
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                size += held[-1]["text"].nbytes
                if size >= SLICE:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, f"slice long, size long, ids array<{kind}>, texts array<string>")


def _targets(places: pa.Array, n: int) -> np.ndarray:
    """Of n texts of a slice, which are the target's: those at places, which is null where none is."""
    out = np.zeros(n, dtype=bool)
    out[places.flatten().to_numpy(zero_copy_only=False)] = True
    return out


class Pairs:
    """The word pairs of a slice's texts. ``words``: distinct hashes in order; ``first`` and ``second``: the words of each pair
    as it stands in the text, by place among them, ``doc`` its text; ``code``: distinct pairs in order of their hashes."""

    def __init__(self, texts: pa.Array):
        distinct, at, counts = split_words(pc.utf8_lower(texts))
        named = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)
        self.words, place = np.unique(np.concatenate(([EDGE], named)), return_inverse=True)
        # each text's words with an edge before and one behind: a text of k words has k + 1 pairs
        ends = np.cumsum(counts + 2)
        line = np.full(ends[-1] if len(ends) else 0, place[0], dtype=np.int64)
        inner = np.ones(len(line), dtype=bool)
        inner[ends - 1] = inner[ends - counts - 2] = False
        line[inner] = place[1:][at]
        doc = np.repeat(np.arange(len(counts)), counts + 2)
        within = np.ones(max(0, len(line) - 1), dtype=bool)
        within[ends[:-1] - 1] = False
        self.first, self.second, self.doc, self.tokens = line[:-1][within], line[1:][within], doc[:-1][within], counts + 1
        self.code, self.at = np.unique(self.first * len(self.words) + self.second, return_inverse=True)

    def dealt(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, edges): the distinct pairs by group, which their first word decides, and where each group's begin."""
        group = (self.words[self.code // len(self.words)] % np.uint64(groups)).astype(np.int64)
        return np.argsort(group, kind="stable"), np.searchsorted(np.sort(group), np.arange(groups + 1))


def _numbers(x: np.ndarray, kind: str) -> bytes:
    """Whole numbers by place of their bytes, all lowest ones first: most are small, and the rest is zeros, which compress."""
    own = np.ascontiguousarray(x, dtype=kind).reshape(-1)
    return own.view(np.uint8).reshape(len(own), -1).T.tobytes() if len(own) else b""


def _read(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _asking(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                texts = batch["texts"].slice(i, 1).flatten()
                target, own = _targets(batch["places"].slice(i, 1), len(texts)), Pairs(texts)
                both = np.stack([np.bincount(own.at[target[own.doc] == k], minlength=len(own.code)) for k in (True, False)])
                order, edges = own.dealt(groups)
                out = []
                for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    first, second = np.divmod(own.code[order[a:b]], len(own.words))
                    words, many = np.unique(first, return_counts=True)
                    out.append((g, batch["slice"][i].as_py(), own.words[words].tobytes(), _numbers(many, "<u4"), own.words[second].tobytes(), *(_numbers(x[order[a:b]], "<u4") for x in both)))
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in ASKED.split(", ")])

    return run


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """What all slices together have of a group's pairs, to each slice in the order that it asked in: of its first words the
    counts and the numbers of distinct words behind them, of its pairs the counts, target and background. With it go the
    group's tokens, target and background, and words; every slice asks every group, so that it can add them up."""
    rows = asked.to_pylist()
    counts = lambda c: np.concatenate([_read(r[c], "<u4") for r in rows])
    words, second = ([np.frombuffer(r[c], dtype="<u8") for r in rows] for c in ("first", "second"))
    firsts, a = np.unique(np.concatenate(words), return_inverse=True)
    seconds, b = np.unique(np.concatenate(second), return_inverse=True)
    code, at = np.unique(np.repeat(a, counts("many")) * len(seconds) + b, return_inverse=True)
    seen = np.stack([np.bincount(at, weights=counts(c), minlength=len(code)) for c in ("target", "background")]).astype(np.int64)
    first = code // max(1, len(seconds))
    stats = np.stack([f for s in seen for f in (np.bincount(first, weights=s, minlength=len(firsts)), np.bincount(first[s > 0], minlength=len(firsts)))]).astype(np.int64)
    totals, out, w, p = [*seen.sum(axis=1).tolist(), len(firsts)], [], 0, 0
    for i, r in enumerate(rows):
        own, its = a[w : w + len(words[i])], at[p : p + len(second[i])]
        w, p = w + len(own), p + len(its)
        out.append((r["grp"], r["slice"], _numbers(stats[:, own], "<i8"), _numbers(seen[:, its], "<u4"), totals))
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in ANSWERED.split(", ")])


def losses(own: Pairs, target: np.ndarray, stats: np.ndarray, seen: np.ndarray, tokens: list[int], n_words: int) -> np.ndarray:
    """(2, texts): mean nats a token of each text under the target and the background, its own counts taken off.

    stats: of each word of the slice, target count and successors, background count and successors; seen: of each distinct
    pair its two counts; tokens: all of both parts."""
    n, docs = len(own.words), len(own.tokens)
    # how often each text has each of its pairs and words
    pair, place = np.unique(own.doc * len(own.code) + own.at, return_inverse=True)
    its = np.bincount(place, minlength=len(pair))
    doc, code = pair // max(1, len(own.code)), pair % max(1, len(own.code))
    first, second = np.divmod(own.code[code], n)
    word, at_first = np.unique(doc * n + first, return_inverse=True)
    count = np.bincount(at_first, weights=its, minlength=len(word))
    at_second = np.searchsorted(word, doc * n + second)  # every word of a text, and its edge, is the first of some pair
    out = np.zeros((2, docs))
    for k, part in enumerate((True, False)):
        mine = target[doc] == part
        off = np.where(mine, its, 0)
        both = seen[k][code] - off
        gone = np.bincount(at_first, weights=mine & (both == 0), minlength=len(word))[at_first]
        own_first, own_second = (np.where(mine, count[x], 0) for x in (at_first, at_second))
        whole = stats[2 * k][first] - own_first + 1.0
        rest = (1.0 + DISCOUNT * (stats[2 * k + 1][first] - gone)) / whole
        single = (stats[2 * k][second] - own_second + 1.0) / (tokens[k] - np.where(mine, own.tokens[doc], 0) + n_words)
        out[k] = np.bincount(doc, weights=-its * np.log(np.maximum(both - DISCOUNT, 0) / whole + rest * single), minlength=docs)
    return out / own.tokens


def _scoring(groups: int, id_type: pa.DataType, names: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, text = (pa.concat_arrays([c.flatten() for c in texts[x].chunks]) for x in ("ids", "texts"))
        target, own = _targets(pa.concat_arrays(texts["places"].chunks), len(text)), Pairs(text)
        order, edges = own.dealt(groups)
        stats, seen = np.zeros((4, len(own.words)), dtype=np.int64), np.zeros((2, len(own.code)), dtype=np.int64)
        rows = answers.to_pylist()
        *tokens, n_words = np.sum([r["totals"] for r in rows], axis=0).tolist()
        for r in rows:
            at = order[edges[r["grp"]] : edges[r["grp"] + 1]]
            seen[:, at] = _read(r["pairs"], "<u4").reshape(2, -1)
            stats[:, np.unique(own.code[at] // len(own.words))] = _read(r["words"], "<i8").reshape(4, -1)
        mean = losses(own, target, stats, seen, tokens, n_words)
        return pa.Table.from_arrays([ids.cast(id_type), *map(pa.array, (own.tokens, *mean, mean[0] - mean[1]))], names=names)

    return score


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, target_loss, background_loss, difference): nats a token, and target less background; low is like the target.

    target: ids of the target's documents. A token is a word, or the end of the text; null and empty texts have the end
    alone. Repeated rows are counted and scored as often as they are there, each with its own counts taken off; repeated
    ids in target count once. An empty target, or one that is all, gives differences all the same: the models are
    smoothed. Extra columns are left out, so none clashes. No rows: none. To the driver come two numbers.
    Texts are laid out at once; what is asked, answered and scored is computed when the result is read, each time.
    """
    spark = docs.sparkSession
    slots = Slots(spark)
    # a table in buckets of the slice: texts are never shuffled, only what is asked of them and answered, and their places
    name = f"slices_{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sliced(rows).write.option("path", f"{slots.folder}/slices").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").saveAsTable(name)
    texts = spark.table(name)
    chosen = target.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    places = texts.select("slice", F.posexplode("ids").alias("place", "id")).join(chosen.hint("merge"), "id")
    places = slots.keep("places", places.groupBy("slice").agg(F.collect_list("place").alias("places")))
    marked = texts.join(places.hint("shuffle_hash"), "slice", "left")
    n_slices, size = texts.agg(F.count("*"), F.sum("size")).first()
    groups = max(1, min(n_slices, (size or 0) // SLICE))
    answers = marked.select("slice", "texts", "places").mapInArrow(_asking(groups), ASKED).groupBy("grp").applyInArrow(_answer, ANSWERED)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "difference"))])
    scoring = _scoring(groups, to_arrow_type(id_type), schema.names)
    return marked.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scoring, schema)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels").where("quality = 1"))
