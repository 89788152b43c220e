"""Comparing methods: alignment, skill against a reference, deltas, best method, ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .attach import attach
from ..functions.skill import HIGHER_IS_BETTER, skill


def align(preds: DataFrame, keys, ts: str, n_methods: int) -> DataFrame:
    """Keep the (key, time) targets that every one of ``n_methods`` methods predicts."""
    group = W.partitionBy(*keys, ts)   # at most one row per method
    ok = preds.filter(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
    return ok.withColumn("_m", F.count(F.lit(1)).over(group)).filter(F.col("_m") == n_methods).drop("_m")


def long_metrics(metrics: DataFrame, by, names) -> DataFrame:
    """Wide metric rows to (by..., metric, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def skill_against(metrics: DataFrame, by, reference: str, metric: str = "rmse", out: str = "skill") -> DataFrame:
    """Skill of each ``method`` against the reference method of the same group."""
    ref = metrics.filter(F.col("method") == reference).select(*by, F.col(metric).alias("_ref"))
    return attach(metrics, ref, by).withColumn(out, skill(F.col(metric), F.col("_ref"), metric in HIGHER_IS_BETTER)).drop("_ref")


def deltas(long_rows: DataFrame, keys, before: str, after: str) -> DataFrame:
    """after - before for each metric of each key."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    return (long_rows.groupBy(*keys, "metric")
            .agg(pick(before).alias("before_value"), pick(after).alias("after_value"))
            .withColumn("delta", F.col("after_value") - F.col("before_value")))


def best(metrics: DataFrame, by, metric: str = "rmse") -> DataFrame:
    """Method with the best metric per group (ties: alphabetical)."""
    v = -F.col(metric) if metric in HIGHER_IS_BETTER else F.col(metric)
    return metrics.groupBy(*by).agg(F.min(F.struct(v.alias("v"), F.col("method"), F.col(metric).alias("m"))).alias("b")) \
        .select(*by, F.col("b.method").alias("best_method"), F.col("b.m").alias(f"best_{metric}"))


def ablate(fit_predict, feature_sets: dict[str, list[str]]) -> DataFrame:
    """Predictions of ``fit_predict(features)`` for each named feature set, stacked by method."""
    return reduce(DataFrame.unionByName,
                  [fit_predict(cols).withColumn("method", F.lit(name)) for name, cols in feature_sets.items()])


def top_features(importances: DataFrame, k: int = 3) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
