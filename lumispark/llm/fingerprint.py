"""Document fingerprints: a homomorphic multiset hash, in SQL functions only.

A text is a multiset of paragraphs. Each paragraph is hashed; the hashes are added into the lanes of a wide vector, each
lane modulo a power of two. Sums commute, so order does not matter; a paragraph is inserted or deleted by adding or
subtracting its own vector. Three groups of lanes:

- paragraph lanes: a paragraph (a line, without white space at its ends) adds to one of them, modulo 2^8;
- run lanes: the same for each run of up to 8 words within a line, so that texts of few paragraphs can be likened too;
  both have levels, each with an eighth of the hashes of the one before, so that long texts can be likened as well;
- whole lanes: every paragraph adds to each of them, modulo 2^32; 128 bits in which unequal multisets agree by accident
  only, which is what equality rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.common import cut, table

LANES = 128  # of a level of paragraphs, and as many of one of runs
LEVELS, SPARSER = 7, 3  # level j holds the hashes whose SPARSER * j bits from bit 16 on are all zero: one in 8^j
FULL = LANES // 2  # lanes of a level in use beyond which it is saturated
OUTER, INNER = 16, 8  # LANES, split so that a hash is looked at OUTER + INNER times and not LANES times
#: Up to 8 words of one line with the white space between them.
RUN = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,7}"
PARAGRAPH = r"[^\x20\x09-\x0D](?:[^\n]*[^\x20\x09-\x0D])?"
#: Code points that a bucket of the neighbour search should hold.
BUCKET_CHARS = 8_000_000
MOST_BUCKETS = 20_000


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: what stands outside a lambda is computed anew for each of its calls."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lanes(hashes: Column) -> Column:
    """LANES sums modulo 2^8, as array<tinyint>: bits 0-3 and 4-6 of a hash name the lane, bits 8-15 are its value (never 0)."""
    coarse = F.transform(F.sequence(F.lit(0), F.lit(OUTER - 1)), lambda g: F.filter(hashes, lambda h: h.bitwiseAND(OUTER - 1) == g))

    def fine(sub: Column) -> Column:
        def lane(k: Column) -> Column:
            value = lambda h: F.shiftright(h, 8).bitwiseAND(255)
            mine = F.filter(sub, lambda h: F.shiftright(h, 4).bitwiseAND(INNER - 1) == k)
            total = F.aggregate(mine, F.lit(0).cast("long"), lambda a, h: (a + F.greatest(value(h), F.lit(1))).bitwiseAND(255))
            return (total - F.lit(128)).cast("tinyint")

        return F.transform(F.sequence(F.lit(0), F.lit(INNER - 1)), lane)

    return F.flatten(F.transform(coarse, fine))


def _levels(hashes: Column) -> Column:
    """The lanes of all levels, end to end; a level without hashes is not looked at."""
    masks = F.array(*(F.lit(((1 << (SPARSER * j)) - 1) << 16).cast("long") for j in range(LEVELS)))
    empty = F.array_repeat(F.lit(-128).cast("tinyint"), LANES)
    level = lambda sub: F.when(F.size(sub) == 0, empty).otherwise(_lanes(sub))
    return F.flatten(F.transform(masks, lambda m: _let(F.filter(hashes, lambda h: h.bitwiseAND(m) == 0), level)))


def vector(text: Column) -> Column:
    """The vector of a text: (paragraphs, runs: array<tinyint>, whole: array<bigint>). A text without words has the zero vector."""
    hashed = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.xxhash64(p))
    second = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p, F.lit("second")))
    mod = 0xFFFFFFFF
    part = lambda hs, shift: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + F.shiftright(h, shift).bitwiseAND(mod)).bitwiseAND(mod))
    whole = lambda hs: F.array(part(hs, 0), part(hs, 32))
    paragraphs = _let(hashed(PARAGRAPH), lambda hs: F.struct(_levels(hs).alias("lanes"), whole(hs).alias("whole")))
    return _let(
        paragraphs,
        lambda p: F.struct(p["lanes"].alias("paragraphs"), _let(hashed(RUN), _levels).alias("runs"), F.concat(p["whole"], _let(second, whole)).alias("whole")),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the union of two multisets (sign 1: insertion), or of a without b (sign -1: deletion)."""
    small = lambda f: F.zip_with(a[f], b[f], lambda x, y: (((x.cast("int") + 128) + sign * (y.cast("int") + 128)).bitwiseAND(255) - 128).cast("tinyint"))
    return F.struct(
        small("paragraphs").alias("paragraphs"),
        small("runs").alias("runs"),
        F.zip_with(a["whole"], b["whole"], lambda x, y: (x + sign * y).bitwiseAND(0xFFFFFFFF)).alias("whole"),
    )


def encode(v: Column) -> Column:
    """A vector as lowercase hex digits."""
    small = F.transform(F.concat(v["paragraphs"], v["runs"]), lambda x: F.lpad(F.hex(x.cast("int") + 128), 2, "0"))
    return F.lower(F.array_join(F.concat(small, F.transform(v["whole"], lambda x: F.lpad(F.hex(x), 8, "0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the multisets agree; else the share of equal lanes among those used on either side, of paragraphs or
    of runs, whichever is more. A lane differs once a paragraph that falls into it does, so lanes are taken from the lowest
    level that is not saturated on either side."""

    def share(f: str) -> Column:
        part = lambda x, j: F.slice(x[f], j * LANES + 1, LANES)
        roomy = lambda x, j: F.size(F.filter(part(x, j), lambda v: v != -128)) <= FULL

        def at(j: Column) -> Column:
            used = F.zip_with(part(a, j), part(b, j), lambda x, y: F.when((x != -128) | (y != -128), (x == y).cast("int")))
            return F.filter(used, lambda x: x.isNotNull())

        rate = lambda used: F.when(F.size(used) > 0, F.aggregate(used, F.lit(0), lambda s, x: s + x) / F.size(used)).otherwise(0.0)
        found = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda j: roomy(a, j) & roomy(b, j))
        return _let(F.coalesce(F.get(found, F.lit(0)), F.lit(LEVELS - 1)), lambda j: _let(at(j), rate))

    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.least(F.lit(0.99), F.greatest(share("paragraphs"), share("runs"))))


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the value (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    listed, steps = F.array(*map(F.lit, bounds)), [2**k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with ``vec``, the vector of their text, and ``next_text`` and ``next_vec`` of the row after, by ascending id, in a ring.

    Ids are dealt to buckets by quantiles: whole ranges of ids, so many that one holds about BUCKET_CHARS, MOST_BUCKETS at
    most (a window sorts outside memory, so that a bucket may be large). Inside a bucket a window finds the row after; the
    last row of a bucket takes the first row of the next bucket. The one shuffle of texts is by bucket, and no window runs
    over all rows. Null ids come first; equal ids go by a hash of the text. Of a single row the next is itself.
    """
    docs = docs.withColumn("tie", F.xxhash64(text_col))
    total = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    n = min(MOST_BUCKETS, max(1, total // BUCKET_CHARS))
    found = docs.approxQuantile(id_col, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    docs = docs.withColumn("bucket", _bucket(F.col(id_col), sorted({int(x) for x in found})))
    # the first row of each bucket: MOST_BUCKETS rows of an id and a hash, so they may be broadcast
    first = docs.groupBy("bucket").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), "tie")).alias("f"))
    used = sorted(r[0] for r in first.select("bucket").collect())
    to = F.create_map(*[F.lit(x) for i, b in enumerate(used) for x in (b, used[i - 1])]) if used else F.create_map(F.lit(0), F.lit(0))
    first = F.broadcast(first.select("bucket", F.col("f.id").alias("first_id"), F.col("f.tie").alias("first_tie")))
    heads = docs.join(first, "bucket").where(F.col(id_col).eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    heads = cut(heads.select(to[F.col("bucket")].alias("bucket"), F.col(text_col).alias("head_text")).dropDuplicates(["bucket"]))
    heads = heads.withColumn("head_vec", vector(F.col("head_text")))
    docs = docs.withColumn("vec", vector(F.col(text_col)))
    after = F.lead(F.struct(F.col(text_col).alias("text"), "vec")).over(Window.partitionBy("bucket").orderBy(id_col, "tie"))
    docs = docs.withColumn("after", after).join(heads, "bucket", "left")
    last = F.col("after").isNull()
    return (
        docs.withColumn("next_text", F.when(last, F.col("head_text")).otherwise(F.col("after.text")))
        .withColumn("next_vec", F.when(last, F.col("head_vec")).otherwise(F.col("after.vec")))
        .drop("tie", "bucket", "after", "head_text", "head_vec")
    )


def fingerprint(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the encoded fingerprint of a text column; null counts as empty. Row by row, without a shuffle."""
    return docs.withColumn(to, encode(vector(F.coalesce(F.col(text_col), F.lit("")))))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, "doc_id", "text").withColumn("n", F.length("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    # the edited vector is used three times: computed once, in a step that the optimiser does not merge with its uses
    out = near.select("doc_id", F.col("n").cast("long").alias("n_chars"), "vec", "next_vec", edited.alias("edited"))
    out = out.withColumn("made", F.explode(F.array(F.struct(vector(F.col("edited")).alias("vec")))))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("vec")).alias("fingerprint"),
        encode(F.col("made.vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("made.vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
