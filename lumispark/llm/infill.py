"""Fill-in-the-middle: texts cut at two token boundaries and put in another order, so that the middle comes last.

Where the token of a rank ends is asked of a learned index: the boundary offsets of a text, by rank, are fitted by straight
lines whose error is bounded; what a line misses at each boundary is kept in a byte. A cut is a line's prediction, put right
by that byte, and so exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.llm.common import slices, table

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a line may miss at most, so that every residual fits a byte; bytes of texts that are indexed at once.
ERROR, SLICE = 127, 4_000_000


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, edges): where tokens begin and end, text after text, and where each text's offsets begin among them.

    A text of n tokens has n + 1 offsets in code points, the first of them 0. A token is a word with the ASCII white space
    before it; white space at the end of a text is one by itself."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    white = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    last = np.zeros(len(chars), dtype=bool)
    last[ends[sizes > 0] - 1] = True
    is_end = last.copy()
    is_end[:-1] |= ~white[:-1] & white[1:]
    at = np.flatnonzero(is_end) + 1
    tokens = np.diff(np.searchsorted(at, np.concatenate(([0], ends)), side="right"))
    edges = np.concatenate(([0], np.cumsum(tokens + 1)))
    offsets = np.zeros(edges[-1], dtype=np.int64)
    inner = np.ones(edges[-1], dtype=bool)
    inner[edges[:-1]] = False
    offsets[inner] = at - np.repeat(ends - sizes, tokens)
    return offsets, edges


class RankIndex:
    """Offsets by rank as lines of bounded error with residuals: first rank, first offset, rise and run of each line, and a
    byte for each offset. Arithmetic is in whole numbers, so a prediction is the same wherever it is made."""

    def __init__(self, offsets: np.ndarray, edges: np.ndarray):
        """One line for each text to begin with; a line that misses a boundary by more than ERROR is halved."""
        self.residual = np.zeros(len(offsets), dtype=np.int8)
        low, high = edges[:-1], edges[1:] - 1  # both ends are boundaries of the same text
        done = []
        while len(low):
            run, rise = np.maximum(high - low, 1), offsets[high] - offsets[low]
            size = high - low + 1
            first = np.cumsum(size) - size
            own = np.repeat(np.arange(len(low)), size)
            rank = np.arange(size.sum()) - first[own] + low[own]
            missed = offsets[rank] - (offsets[low][own] + rise[own] * (rank - low[own]) // run[own])
            fits = np.maximum.reduceat(np.abs(missed), first) <= ERROR
            kept = fits[own]
            self.residual[rank[kept]] = missed[kept]
            done.append(np.stack((low, offsets[low], rise, run))[:, fits])
            low, high = low[~fits], high[~fits]
            half = (low + high) // 2
            low, high = np.concatenate((low, half + 1)), np.concatenate((half, high))
        lines = np.concatenate(done, axis=1) if done else np.zeros((4, 0), dtype=np.int64)
        self.first, self.offset, self.rise, self.run = lines[:, np.argsort(lines[0], kind="stable")]

    def offset_of(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of ranks, counted over all texts: predicted by their line, corrected by their residual."""
        line = np.searchsorted(self.first, rank, side="right") - 1
        return self.offset[line] + self.rise[line] * (rank - self.first[line]) // self.run[line] + self.residual[rank]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "low", "high")]))
def _cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Tokens of each text, and the two offsets that the numbers choose among its boundaries, the smaller first."""
    asked = np.stack([x.to_numpy(zero_copy_only=False) for x in (one, other)])
    out = np.zeros((3, len(text)), dtype=np.int64)
    for a, b in slices(text, SLICE):
        offsets, edges = boundaries(text.slice(a, b - a).to_pylist())
        index, count = RankIndex(offsets, edges), np.diff(edges)  # a text has one boundary more than tokens
        rank = edges[:-1] + np.sort(asked[:, a:b] % count, axis=0)
        out[:, a:b] = count - 1, index.offset_of(rank[0]), index.offset_of(rank[1])
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "low", "high"])


def numbers(id_: Column, seed: int) -> list[Column]:
    """Four whole numbers of 32 bits from the id: the same wherever and whenever they are made. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, plain: int = 50, spm: int = 80) -> DataFrame:
    """(id_col, text_col, n, form, prefix_chars, middle_chars, output): a row for each row of docs.

    n counts tokens. Of a hundred texts ``plain`` stay as they are; of a hundred others ``spm`` go suffix first, the rest
    prefix first; the id decides, and where the cuts are. A text that is empty or has one of the marks is plain; a plain
    one has no prefix and no middle (null). Null texts count as empty. Rows that agree in id and text agree in all;
    repeated rows are each given. Extra columns are left out, so none clashes. An empty table gives none. Parts may be empty.
    No row meets another: there is no shuffle, and a long text is held by one task alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = numbers(F.col(id_col), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col), F.col(text_col), text.alias("__text"), form.alias("form"), _cuts(text, h1, h2).alias("__at"))
    cut = F.col("form") != "plain"
    part = lambda a, b: F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int"))
    low, high = F.col("__at.low"), F.col("__at.high")
    prefix, middle, suffix = part(F.lit(0), low), part(low, high), part(high, F.lit(2**31 - 1))
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm_text = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    return rows.select(
        id_col,
        text_col,
        F.col("__at.n").alias("n"),
        "form",
        F.when(cut, low).alias("prefix_chars"),
        F.when(cut, high - low).alias("middle_chars"),
        F.when(F.col("form") == "spm", spm_text).when(F.col("form") == "psm", psm_text).otherwise(F.col("__text")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that has a mark is never cut, so an output has each mark once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *order: F.concat(*(F.try_element_at(parts, F.lit(i)) for i in order))
    return F.when(form == "spm", at(3, 4, 2)).when(form == "psm", at(2, 4, 3)).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL_INFILL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
v AS (
  SELECT doc_id, text, parts, CAST(len(parts) AS BIGINT) AS n,
    least(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS low, greatest(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
w AS (
  SELECT doc_id, text, n, form, array_to_string(parts[1:low], '') AS prefix, array_to_string(parts[low + 1:high], '') AS middle,
    array_to_string(parts[high + 1:n], '') AS suffix
  FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM w
"""
