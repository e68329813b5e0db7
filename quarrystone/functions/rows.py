"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, items: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per (non-null) element.

    The outer form is used because the optimizer guards the inner one with a filter on the array's
    size, which computes a derived array a second time.
    """
    out = F.posexplode_outer(items).alias(pos, value) if pos else F.explode_outer(items).alias(value)
    return df.select(*keep, out).where(F.col(value).isNotNull())
