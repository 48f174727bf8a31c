"""Secret scans with multipart credential linking, in SQL functions only.

Strong kinds are reported by themselves. Weak candidates (an account identifier, an opaque token, an endpoint) are
common in clean text; they are reported only when complementary parts lie in one scope, found by an interval join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.llm.common import cut, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # greedy and leftmost: the whole run, as of [0-9a-f]+ with 16 or more characters
#: The kinds in the order of a report: (kind, pattern). The first three are the strong ones.
STRONG = ("assign", "access", "hex")
WEAK = {
    "ident": r"(?i:client_?id|account_?id|user_?name|login|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,}",
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{24})(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}+",
    "endpoint": r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
}
KINDS = (*STRONG, *WEAK)
#: One of these strings is in every match of the kind.
HOLDS = {"assign": (":", "="), "access": ("AKIA",), "ident": (":", "="), "endpoint": ("://",)}
#: Code points between two parts that still belong together.
SCOPE = 200
SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """[(start, end, kind)] of the matches of a pattern, in code points: matches and the pieces between them alternate."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(whole, lambda x: F.length(x).cast("long")).alias("size"),
        *([F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), keep).alias("ok")] if keep else []),
    )
    walk = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPAN).alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.coalesce(m["size"], F.lit(0))).alias("at"),
            F.when(
                m["size"].isNotNull() & (m["ok"] if keep else F.lit(True)),
                F.concat(
                    F.coalesce(acc["out"], F.array().cast(SPAN)),
                    F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["size"]).alias("end"), F.lit(KINDS.index(kind)).alias("kind"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )["out"]
    # a plain search for what every match holds spares most texts the pattern
    held = [text.contains(x) for x in HOLDS.get(kind, ())]
    some = reduce(or_, held) & text.rlike(pattern) if held else text.rlike(pattern)
    return F.when(some, F.coalesce(walk, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def strong_spans(text: Column) -> Column:
    """The strong spans of a text, by start and then kind."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", lambda x: F.length(x) >= 12),
            F.filter(_spans(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= 18),
            _spans(text, HEX, "hex"),
        )
    )


def weak_spans(text: Column) -> Column:
    return F.concat(*(_spans(text, p, k) for k, p in WEAK.items()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the same id and text have the same spans, so that pair is the key and copies of a row share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__key", F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64("__text").alias("h"), F.length("__text").alias("n")))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__key, start, end, kind): the weak parts that a complementary part is near to.

    parts: __key, start, end, kind. An interval join: every part is posted in the cells of ``scope`` code points that it
    touches, widened by the scope on one side, and parts meet in a cell of one text. A weak part is reported if
    - an ident or endpoint has a secret (assign, hex, opaque) near, and the endpoint an identifier (access, ident) too;
    - an opaque has an identifier (access, ident) near.
    A text with very many parts is spread over its cells; no task gets a whole text's pairs.
    """
    at = lambda c: F.floor(F.col(c) / scope)
    role = F.when(F.col("kind").isin(KINDS.index("access"), KINDS.index("ident")), "i").when(F.col("kind") == KINDS.index("endpoint"), "e").otherwise("s")
    parts = parts.distinct().withColumn("role", role)
    weak = parts.where(F.col("kind") >= len(STRONG)).withColumn("cell", F.explode(F.sequence(at("start") - 1, F.floor((F.col("end") + scope) / scope))))
    # a neighbour is known by its first cell and, for long ones, by each cell that it covers; only roles matter, with the outermost ends
    near = parts.withColumn("cell", F.explode(F.sequence(at("start"), at("end"))))
    near = near.select("__key", "cell", F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    hit = weak.join(near, ["__key", "cell"]).where((F.col("role") != F.col("r")) & (F.col("s") <= F.col("end") + scope) & (F.col("start") <= F.col("e") + scope))
    got = hit.groupBy("__key", "start", "end", "kind", "role").agg(F.max((F.col("r") == "s").cast("int")).alias("s"), F.max((F.col("r") == "i").cast("int")).alias("i"))
    return got.where("(role = 'i' and s = 1) or (role = 's' and i = 1) or (role = 'e' and s = 1 and i = 1)").select("__key", "start", "end", "kind")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with ``strong_spans`` and ``spans``: arrays of (start, end, kind number), code points, end exclusive.

    Null text counts as empty. Repeated rows each keep their spans. Extra columns stay as they are; columns named like
    the added ones are replaced. An empty table gives an empty result. Only positions are shuffled, never texts.
    """
    docs = docs.drop("strong_spans", "spans")
    keyed = _keyed(docs, id_col, text_col)
    # every link has an identifier at one end, so texts that cannot hold one have no part in the join
    can = reduce(or_, (F.col("__text").contains(x) for x in {*HOLDS["access"], *HOLDS["ident"]}))
    parts = (
        keyed.where(can)
        .select("__key", F.explode(F.concat(strong_spans(F.col("__text")), weak_spans(F.col("__text")))).alias("p"))
        .select("__key", "p.start", "p.end", "p.kind")
    )
    linked = (
        cut(link(parts, scope))
        .groupBy("__key")
        .agg(F.collect_list(F.struct("start", "end", "kind")).alias("__linked"))
    )
    none = F.array().cast(SPAN)
    out = keyed.withColumn("strong_spans", strong_spans(F.col("__text"))).join(linked, "__key", "left")
    # a weak span inside a strong one says nothing new
    extra = F.filter(F.coalesce("__linked", none), lambda w: ~F.exists(F.col("strong_spans"), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return out.withColumn("spans", F.array_sort(F.concat("strong_spans", extra))).drop("__key", "__text", "__linked")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; overlapping spans become one."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
                .alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(walk["out"], F.substring(text, (walk["at"] + 1).cast("int"), F.length(text))))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in STRONG),
        F.sha2(_joined(F.col("strong_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
