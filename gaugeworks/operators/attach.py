"""Attaching small per-key results to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key; the keys come from ``left``."""
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def attach(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Join a table with one row per key; without keys its single row comes in as a scalar subquery."""
    keys = list(keys)
    if keys:
        return null_safe(df, small, keys)
    row = small.select(F.struct(*small.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")
