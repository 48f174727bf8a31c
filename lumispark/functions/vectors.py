"""Vectors of probabilities and of light curves, as SQL expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumispark.schemas import COARSE, FINE, LEAF, LENGTH_BUCKETS, PARENT

INF = float("inf")


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; NaN is over every number in Spark, so it has to be asked for."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def first_maximum(a: Column) -> Column:
    """1-based position of the first maximum. NaN wins only in the first place, as plain comparison has it; null if empty."""
    seen = F.transform(a, lambda x, i: F.when(F.isnan(x), F.when(i == 0, INF).otherwise(-INF)).otherwise(x))
    return F.when(F.size(a) > 0, F.array_position(seen, F.array_max(seen)).cast("int"))


def class_of(a: Column, classes: dict[str, int]) -> Column:
    return F.get(F.array(*map(F.lit, classes.values())), first_maximum(a) - 1)


def fuse(coarse: Column, fine: Column) -> Column:
    """Leaf probabilities in single precision: coarse of the parent times fine; two classes copy their coarse value."""
    at = {name: i for i, name in enumerate(COARSE)}
    products = [(F.get(coarse, F.lit(at[PARENT[name]])) * F.get(fine, F.lit(i))).cast("float") for i, name in enumerate(FINE)]
    return F.array(*products, *(F.get(coarse, F.lit(at[name])).cast("float") for name in list(LEAF)[10:]))


def probabilities_fine(a: Column, length: int) -> Column:
    """Exactly ``length`` values, all finite and in 0..1."""
    return F.coalesce((F.size(a) == length) & F.forall(a, lambda p: finite(p) & p.between(0, 1)), F.lit(False))


def sums_to_one(a: Column, relative: float = 1e-5, absolute: float = 1e-6) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, p: s + p.cast("double"))
    return F.coalesce(F.abs(total - 1.0) <= absolute + relative, F.lit(False))


def contract_sums(coarse: Column, fine: Column, leaf: Column) -> Column:
    """Coarse, each of the five pairs of fine, and leaf sum to 1 within tolerance."""
    checks = sums_to_one(coarse) & sums_to_one(leaf)
    for i in range(1, 10, 2):
        checks = checks & sums_to_one(F.slice(fine, i, 2))
    return checks


def close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    """Same length and each |a - b| within absolute + relative |b|."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y) <= absolute + relative * F.abs(y.cast("double"))), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False))


def normalised_times(t: Column) -> Column:
    """t - (floor(min) - 1), subtracted in double and then cast to single precision."""
    return F.transform(t, lambda x: (x - (F.floor(F.array_min(t)) - 1)).cast("float"))


def centred(m: Column) -> Column:
    """Magnitudes less their mean, accumulated in single precision."""
    mean = (F.aggregate(m, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float")) / F.size(m)).cast("float")
    return F.transform(m, lambda x: (x - mean).cast("float"))


def length_bucket(n: Column) -> Column:
    """The first bucket that holds n epochs; null beyond the last."""
    return F.get(F.filter(F.array(*map(F.lit, LENGTH_BUCKETS)), lambda b: b >= n), F.lit(0))


def padded(a: Column, to: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), (to - F.size(a)).cast("int")))


def mask(n: Column, to: Column) -> Column:
    """1 for each epoch, then 0; from the length, never from values."""
    return F.concat(F.array_repeat(F.lit(1.0).cast("float"), n.cast("int")), F.array_repeat(F.lit(0.0).cast("float"), (to - n).cast("int")))


def ranked(a: Column, names: list[str]) -> Column:
    """(label, probability, place) by falling probability, ties by place; labels past the names are INDEX_i."""
    label = lambda i: F.coalesce(F.get(F.array(*map(F.lit, names)), i), F.concat(F.lit("INDEX_"), i.cast("string")))
    entries = F.transform(a, lambda p, i: F.struct(label(i).alias("label"), p.alias("probability"), i.alias("place")))
    order = lambda x, y: F.when(x["probability"] > y["probability"], -1).when(x["probability"] < y["probability"], 1).otherwise(x["place"] - y["place"])
    return F.array_sort(entries, order)


def parse_number(s: Column, kind: str) -> Column:
    """A decimal number as double or float; null for what is no number or, as float, out of range. Spark's cast alone takes
    a trailing f or d and turns too large a float into infinity. Names of infinities and NaN parse, to be judged later."""
    plain = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
    special = r"(?i)^([+-]?inf(inity)?|nan)\z"
    value = s.try_cast(kind)
    return F.when(s.rlike(special), value).when(s.rlike(plain) & (F.abs(value) < INF), value)
