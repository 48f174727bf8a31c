"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections read, and do not compute anew.

    The optimiser merges a projection with what stands above it and so writes an expression out at each of its uses; a
    decoded message or a long ladder grows large that way. A generator of one row stays a step of its own.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
