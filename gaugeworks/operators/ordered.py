"""Ordered statistics that survive a hot key.

A window over one key runs in one task.  Where a key may hold a large share of
all rows, the operators here first deal that key out into ranges of its order
(Spark's own range partitioning), aggregate each range, carry the range totals
forward, and finish inside each range.  The answers are exact for keys and order
columns of any type, nulls included; the ranges only decide which task does the
work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import store
from .attach import null_safe

HOT_ROWS = 2_000_000   # a key above this many rows is split

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _with_key(df: DataFrame, keys):
    return (df, list(keys)) if keys else (df.withColumn("_g", F.lit(0)), ["_g"])


def with_range_bucket(df: DataFrame, keys, order, hot_rows: int = HOT_ROWS):
    """Add ``_bucket``, a number that grows with ``order`` within each key; returns (df, split?).

    Every key above ``hot_rows`` rows is split, into as many ranges as it needs.
    The ranges of these keys are written to the shared folder, so a recomputed
    task sees the same ones.
    """
    keys = list(keys)
    hot = store(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows), "hot-keys")
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        return df.withColumn("_bucket", F.lit(0)), False
    split = null_safe(df, hot.select(*keys), keys, "left_semi")
    ranges = max(2, math.ceil(rows / hot_rows))
    dealt = store(split.repartitionByRange(ranges, *keys, *order).withColumn("_bucket", F.spark_partition_id()), "ranges")
    rest = null_safe(df, hot.select(*keys), keys, "left_anti").withColumn("_bucket", F.lit(0))
    return dealt.unionByName(rest), True


def running(df: DataFrame, keys, order, measures: dict[str, tuple[str, Column]], *,
            bucket: Column | None = None, totals: bool = False, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Inclusive running aggregates of ``measures`` = {name: (sum|max|min, column)}.

    ``order`` lists ascending column names, unique within a key.  With
    ``totals`` each measure also gets ``tot_<name>`` over the whole key.
    ``bucket`` may give an order-preserving range number directly;
    ``hot_rows=None`` says that the keys are small by construction.
    """
    df, keys2 = _with_key(df, keys)
    if bucket is not None:
        df, split = df.withColumn("_bucket", bucket), True
    elif hot_rows is None:
        df, split = df.withColumn("_bucket", F.lit(0)), False
    else:
        df, split = with_range_bucket(df, keys2, order, hot_rows)
    df = df.select("*", *[c.alias(f"_m_{n}") for n, (_, c) in measures.items()])
    part = keys2 + ["_bucket"] if split else keys2
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.select("*", *[_AGG[a](f"_m_{n}").over(w).alias(n) for n, (a, _) in measures.items()])
    if not split:
        if totals:
            wk = W.partitionBy(*keys2)
            out = out.select("*", *[_AGG[a](f"_m_{n}").over(wk).alias(f"tot_{n}") for n, (a, _) in measures.items()])
    else:
        edge = df.groupBy(*part).agg(*[_AGG[a](f"_m_{n}").alias(f"_e_{n}") for n, (a, _) in measures.items()])
        before = W.partitionBy(*keys2).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*keys2)
        cols = []
        for n, (a, _) in measures.items():
            cols.append(_AGG[a](f"_e_{n}").over(before).alias(f"_c_{n}"))
            if totals:
                cols.append(_AGG[a](f"_e_{n}").over(whole).alias(f"tot_{n}"))
        out = null_safe(out, edge.select(*part, *cols), part)
        for n, (a, _) in measures.items():
            if a == "sum":
                both = F.col(n) + F.col(f"_c_{n}")
                out = out.withColumn(n, F.coalesce(both, F.col(n), F.col(f"_c_{n}")))
            else:
                pick = F.greatest if a == "max" else F.least
                out = out.withColumn(n, pick(n, f"_c_{n}"))
        out = out.drop(*[f"_c_{n}" for n in measures])
    return out.drop("_bucket", "_g", *[f"_m_{n}" for n in measures])


def row_numbers(df: DataFrame, keys, order, *, out: str = "rn", n: str | None = None, **kw) -> DataFrame:
    """1-based row number in ``order`` (unique per key) and, if asked, the key's row count ``n``."""
    res = running(df, keys, order, {out: ("sum", F.lit(1).cast("long"))}, totals=n is not None, **kw)
    return res.withColumnRenamed(f"tot_{out}", n) if n else res


def value_counts(df: DataFrame, keys, value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Distinct values with their count ``n``, running count ``cum`` and key total ``tot``."""
    dist = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    res = running(dist, keys, [value], {"cum": ("sum", F.col("n"))}, totals=True, hot_rows=hot_rows)
    return res.withColumnRenamed("tot_cum", "tot")


def quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one column per entry of ``probs``.

    Works on distinct values with counts, so it never holds a key in one buffer.
    """
    c = value_counts(df, keys, value, hot_rows)
    aggs = [F.max("tot").alias("_tot")]
    for name, p in probs.items():
        h = (F.col("tot") - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("cum") - F.col("n") <= idx) & (idx < F.col("cum"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    res = c.groupBy(*keys).agg(*aggs)
    outs = []
    for name, p in probs.items():
        h = (F.col("_tot") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return res.select(*keys, *outs)


def order_statistic(df: DataFrame, keys, value: str, rank: Column, out: str,
                    hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The ``rank``-th smallest value per key (``rank`` may use the key's row count ``tot``);
    +infinity when the rank exceeds the count."""
    c = value_counts(df, keys, value, hot_rows)
    hit = (F.col("cum") - F.col("n") < rank) & (rank <= F.col("cum"))
    return c.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(hit, F.col(value).cast("double"))), F.lit(float("inf"))).alias(out),
        F.max("tot").alias("n"))


def average_ranks(df: DataFrame, keys, value: str, extra, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Distinct values with ``n``, average rank ``avg_rank`` and the sums named in
    ``extra`` = {name: Column}."""
    dist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in extra.items()])
    res = running(dist, keys, [value], {"cum": ("sum", F.col("n"))}, hot_rows=hot_rows)
    return res.withColumn("avg_rank", F.col("cum") - (F.col("n") - 1) / 2.0)
