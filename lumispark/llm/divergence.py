"""Audit of how sources differ in their words, by hash-consed segment trees over term ids.

The counts of a group (a source of a language) over the kept terms of its language are a segment tree. Equal subtrees,
whatever group and place they have, are one node. Two trees are walked at once from their roots: equal pairs of nodes of a
level are met once, with the number of times that they stand there, and so each pair of counts is priced once.

The terms of a language are dealt to blocks, each the ground of a subtree; sources are dealt to tiles. A task has a block
and two tiles, so what it holds is bounded whatever the vocabulary and the number of sources are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.common import cut, lean, slices, table

#: What stands between terms: ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of a block and sources of a tile; pairs of counts that are priced at once; bytes of texts cut at once; counts held.
BLOCK, TILE, AT_ONCE, SLICE, HELD = 4096, 64, 1 << 20, 4_000_000, 1_000_000
#: A count of no term: it fills a tree up to a power of two.
NONE = -1


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and how many of its documents have it.

    docs: lang, source, text, none of them null. Tasks hand on sums, which Spark adds up."""
    keys = ["lang", "source", "term"]

    def counted(batch: pa.RecordBatch) -> pa.Table:
        found = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), BETWEEN)
        words = found.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(batch)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        blank = pc.index(words.dictionary, "").as_py()  # what stands between at an end of a text leaves an empty one
        doc, at = (doc[at != blank], at[at != blank]) if blank >= 0 else (doc, at)
        many = max(1, len(words.dictionary))
        own, times = np.unique(doc * many + at, return_counts=True)
        langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        cell, place = np.unique(group[own // many] * many + own % many, return_inverse=True)
        which = cell // many
        columns = [langs.dictionary.take(pa.array(which // len(sources.dictionary))), sources.dictionary.take(pa.array(which % len(sources.dictionary))), words.dictionary.take(pa.array(cell % many))]
        sums = [np.bincount(place, weights=times, minlength=len(cell)).astype(np.int64), np.bincount(place, minlength=len(cell))]
        return pa.table([*columns, *map(pa.array, sums)], names=[*keys, "n", "docs"])

    def added(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                parts.append(counted(batch.slice(a, b - a)))
                if sum(map(len, parts)) > HELD:
                    parts = [added(parts)]
                    if len(parts[0]) > HELD // 2:
                        yield from parts.pop().combine_chunks().to_batches()
        if parts:
            yield from added(parts).combine_chunks().to_batches()

    partial = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / whole), exact: three digits at a time, so that nothing leaves 64 bits while whole is
    under 9 * 10^15. whole: all counts of the group, and 5 for each kept term."""
    whole = np.maximum(whole, 1)
    out, rest = np.zeros(np.broadcast(count, whole).shape, dtype=np.int64), count + 5
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


class Forest:
    """Segment trees over the same leaves, hash-consed: ``values`` are the distinct counts, ``levels`` the two children of
    each distinct node, level by level upwards, ``roots`` the root of each tree. Nodes of a level are numbered from 0."""

    def __init__(self, counts: np.ndarray):
        """counts: a row for each tree, as many columns as a power of two; NONE where there is no term."""
        self.values, nodes = np.unique(counts, return_inverse=True)
        nodes, largest = nodes.reshape(counts.shape), self.values
        self.levels, self.largest = [], [largest]
        while nodes.shape[1] > 1:
            base = len(self.largest[-1])
            distinct, place = np.unique(nodes[:, ::2] * base + nodes[:, 1::2], return_inverse=True)
            nodes = place.reshape(len(nodes), -1)
            self.levels.append(np.stack(np.divmod(distinct, base)))
            self.largest.append(self.largest[-1][self.levels[-1]].max(axis=0))
        self.roots = nodes[:, 0]

    def totals(self, left: np.ndarray, right: np.ndarray, price: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of prices over all leaves for each pair of trees; price: (places of pairs, left counts, right counts)."""
        out = np.zeros(len(left), dtype=np.int64)
        some = max(1, AT_ONCE >> len(self.levels))
        for begin in range(0, len(left), some):
            pair = np.arange(begin, min(begin + some, len(left)))
            a, b, times = self.roots[left[pair]], self.roots[right[pair]], np.ones(len(pair), dtype=np.int64)
            for children, below in zip(self.levels[::-1], self.largest[-2::-1], strict=True):
                n = len(below)
                key = np.concatenate([(pair * n + side[a]) * n + side[b] for side in children])
                key, place = np.unique(key, return_inverse=True)
                times = np.bincount(place, weights=np.tile(times, 2)).astype(np.int64)
                pair, a, b = key // (n * n), key // n % n, key % n
            np.add.at(out, pair, times * price(pair, self.values[a], self.values[b]))
        return out

    def leaves(self, tree: int, beside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, counts, counts of the tree beside) of the leaves where a tree has a count over 0; subtrees of none are
        not entered."""
        at, a, b = np.zeros(1, dtype=np.int64), self.roots[[tree]], self.roots[[beside]]
        for children, largest in zip(self.levels[::-1], self.largest[:0:-1], strict=True):
            some = largest[a] > 0
            at, a, b = (np.concatenate([x * 2 + i if k == 0 else children[i][x] for i in (0, 1)]) for k, x in enumerate((at[some], a[some], b[some])))
        some = self.values[a] > 0
        return at[some], self.values[a[some]], self.values[b[some]]


def _audited(top: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What a task does with a block and two tiles: counts (no, term, n, total) and the tiles' sources (no, source, whole, lang_whole)."""

    def audit(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        sources = sources.sort_by("no")
        number, whole, names = sources["no"].to_numpy(), sources["whole"].to_numpy(), sources["source"].to_pylist()
        coded = counts["term"].combine_chunks().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        total = np.zeros(len(words), dtype=np.int64)
        total[at] = counts["total"].to_numpy()
        # frequent terms first, so that the rare ones, of which a group has mostly none, share their subtrees
        order = sorted(range(len(words)), key=lambda i: (-total[i], words[i]))
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        trees = np.full((len(names) + 1, 1 << max(0, len(words) - 1).bit_length()), NONE, dtype=np.int64)
        trees[:, : len(words)] = 0
        trees[np.searchsorted(number, counts["no"].to_numpy()), place[at]] = counts["n"].to_numpy()
        trees[-1, place] = total
        forest = Forest(trees)

        tile = sources["tile"].to_numpy()
        left, right = np.triu_indices(len(names), 1)
        if low != high:
            across = tile[left] != tile[right]
            left, right = left[across], right[across]

        def price(pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(a == NONE, 0, np.abs(share(a, whole[left[pair]]) - share(b, whole[right[pair]])))

        none = np.zeros(1, dtype=np.int64)
        columns = [["pair"] * len(left), [names[i] for i in left], [names[i] for i in right], forest.totals(left, right, price), np.full(len(left), len(words)), np.abs(share(none, whole[left]) - share(none, whole[right]))]
        out = [pa.table([[lang] * len(left), *map(pa.array, columns)], schema=PRICED)]
        if low == high and len(words):
            lang_whole = sources["lang_whole"][0].as_py()
            for i, name in enumerate(names):
                leaf, own, its = forest.leaves(i, len(names))
                more = share(own, whole[i]) - share(its, lang_whole)
                best = sorted((-v, words[order[x]]) for v, x in zip(more[more > 0].tolist(), leaf[more > 0].tolist(), strict=True))[:top]
                k = len(best)
                out.append(pa.table([[lang] * k, ["term"] * k, [name] * k, [w for _, w in best], [-v for v, _ in best], [0] * k, [0] * k], schema=PRICED))
        return pa.concat_tables(out)

    return audit


PRICED = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("terms", pa.int64()), ("absent", pa.int64())])


def audit(docs: DataFrame, least: int = 30, top: int = 50, block: int = BLOCK, tile: int = TILE, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups of docs, with whole-number shares of 10^9 (see ``share``).

    Terms are runs of letters, A-Z lowered, any other code point but ASCII counting as one; a language keeps those that
    ``least`` of its documents have. Part ``pair``: item is each other source of the language, value the sum of what the
    shares of both differ by over all kept terms (0 if there are none). Part ``term``: the ``top`` kept terms by which a
    group's share is over its language's. Ranks go by value, then by the item's bytes.

    Null text, language and source count as empty. Repeated rows are documents of their own. A group without terms has
    its pairs. A language of one source has no pairs. Extra columns are left out, so none clashes. No rows: none.
    Every pair of sources of a language is in the result, so that part grows with their square.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    of_term = Window.partitionBy("lang", "term")
    counts = count_terms(rows).withColumns({"total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "lead": F.min("source").over(of_term) == F.col("source")})
    kept = cut(counts.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "lead"))

    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("kept"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    whole = lambda n: F.col(n) + 5 * F.col("kept")
    groups = groups.withColumns({"whole": whole("group_n"), "lang_whole": whole("lang_n"), "no": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})
    groups = groups.withColumns({"tile": F.floor(F.col("no") / tile), "blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / block))})
    groups = cut(groups.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1))

    def paired(df: DataFrame) -> DataFrame:
        """A copy for each tile that the row's tile meets, its own among them."""
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return df.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    named = groups.select(*(F.col(c).alias(c) for c in ("lang", "source", "no", "tile", "tiles", "blocks")))  # columns of its own: groups is met again below
    left = kept.join(named, ["lang", "source"])
    left = paired(left.withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))).select("lang", "block", "low", "high", "no", "term", "n", "total")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = paired(right).select("lang", "block", "low", "high", "no", "tile", "source", "whole", "lang_whole")
    key = ["lang", "block", "low", "high"]
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_audited(top), "lang string, part string, source string, item string, value long, terms long, absent long")

    # kept terms that no source of a task's tiles has are absent from both: each of them costs the same
    sums = priced.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("absent").alias("absent"))
    sums = sums.join(langs.select("lang", "kept"), "lang", "left").withColumn("value", F.col("value") + F.when(F.col("part") == "pair", (F.coalesce("kept", F.lit(0)) - F.col("terms")) * F.col("absent")).otherwise(0))
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    out = sums.select("lang", "part", "value", F.explode(ways).alias("way")).select("lang", "way.source", "part", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS kept FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * kept) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * kept) AS q
  FROM grid JOIN v USING (lang)),
differ AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differ ON differ.lang = a.lang AND differ.source = a.source AND differ.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 50
"""
