"""Profiles of record tables and gridded fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .attach import null_safe
from .series import CHUNK_ROWS


def counts(df: DataFrame, by, present: dict[str, str] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """Row count per group, non-empty counts ({out: column}) and distinct counts ({out: column})."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias(o) for o, c in (present or {}).items()]
    aggs += [F.count_distinct(c).alias(o) for o, c in (distinct or {}).items()]
    return df.groupBy(*by).agg(*aggs)


def top_k(df: DataFrame, col: str, k: int = 15) -> DataFrame:
    """The k most frequent values (ties by value)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), F.asc(col)).limit(k)


def field_summary(field: DataFrame, by, value: str) -> DataFrame:
    """Count, minimum, maximum, mean and population deviation, NaN ignored."""
    v = F.when(~F.isnan(value), F.col(value))
    return field.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"),
                                  F.avg(v).alias("vmean"), F.stddev_pop(v).alias("vstd"))


def station_qc(df: DataFrame, keys, value: str, low: float = 0.0) -> DataFrame:
    """Rows kept, rows below the physical limit and missing rows per station."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(value) >= low).alias("n_ok"), F.count_if(F.col(value) < low).alias("n_negative"),
        F.count_if(F.col(value).isNull()).alias("n_missing"))


def effort_weighted(df: DataFrame, cell, count: str, effort: str) -> DataFrame:
    """Occurrences per unit of survey effort by cell."""
    return df.groupBy(*cell).agg((F.sum(count) / F.sum(effort)).alias("rate"), F.sum(effort).alias("effort"))


def gap_fill(df: DataFrame, keys, pos: str, value: str, out: str = "filled", linear: bool = False, max_gap: int | None = None,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fill gaps of a dense series from the last value, or linearly between the last and the next.

    Chunks of ``chunk_rows`` positions run apart.  The last and first value of each
    chunk, one row a chunk, are carried over chunks without any, so a gap may be of
    any length.  ``max_gap`` leaves positions null that lie farther than so many steps
    from a value used.  Before the first value (linearly: outside the first and last)
    there is nothing to fill from.
    """
    keys = list(keys)
    part = [*keys, "_chunk"]
    d = df.withColumn("_chunk", F.floor(F.col(pos).cast("long") / chunk_rows))
    hit = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).cast("long").alias("p"), F.col(value).alias("v")))
    ends = d.groupBy(*part).agg(F.max(hit).alias("_last"), F.min(hit).alias("_first"))
    order = W.partitionBy(*keys).orderBy("_chunk")
    carry = ends.select(*part, F.last("_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_from"),
                        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_to"))
    here = W.partitionBy(*part).orderBy(pos)
    d = null_safe(d, carry, part)
    d = d.withColumn("_b", F.coalesce(F.last(hit, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)), F.col("_from")))
    d = d.withColumn("_a", F.coalesce(F.first(hit, ignorenulls=True).over(here.rowsBetween(0, W.unboundedFollowing)), F.col("_to")))
    p = F.col(pos).cast("long")
    near = F.lit(True) if max_gap is None else p - F.col("_b.p") <= max_gap
    if linear:
        w = (p - F.col("_b.p")) / (F.col("_a.p") - F.col("_b.p"))
        close = near if max_gap is None else near & (F.col("_a.p") - p <= max_gap)
        fill = F.when(close & (F.col("_a.p") > F.col("_b.p")), F.col("_b.v") + w * (F.col("_a.v") - F.col("_b.v")))
    else:
        fill = F.when(near, F.col("_b.v"))
    return d.withColumn(out, F.coalesce(F.col(value), fill)).drop("_b", "_a", "_from", "_to", "_chunk")


def pca(df: DataFrame, cols, k: int):
    from pyspark.ml.feature import PCA, VectorAssembler
    d = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df)
    return PCA(k=k, inputCol="_v", outputCol="pc").fit(d)


def kmeans(df: DataFrame, cols, k: int, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    d = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")
