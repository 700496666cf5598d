"""Choosing rows that fit limits, and the best of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitting(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows whose every limited column is at most its limit; a null fits nothing."""
    ok = F.lit(True)
    for c, most in limits.items():
        ok = ok & (F.col(c) <= most)
    return df.where(F.coalesce(ok, F.lit(False)))


def best(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """by, keep: the row with the highest order of each group, by one aggregation."""
    more = [k for k in keep if k not in order]
    return df.groupBy(*by).agg(F.max(F.struct(*order, *more)).alias("m")).select(*by, *[F.col("m")[k].alias(k) for k in keep])
