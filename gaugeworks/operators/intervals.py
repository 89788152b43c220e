"""Prediction intervals: conformal, normal-theory, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import normal_z
from . import models
from .attach import attach
from .ordered import HOT_ROWS, order_statistic

FLOOR_SHARE = 0.1   # the residual scale never falls below this share of the mean absolute residual


def conformal_quantile(scores: DataFrame, keys, score: str, level: float, out: str = "q",
                       hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rank ceil((n+1) * level) of the scores; +infinity when the rank exceeds n."""
    rank = F.ceil((F.col("tot") + 1).cast("double") * F.lit(float(level)))
    return order_statistic(scores, keys, score, rank, out, hot_rows)


def split_conformal(cal: DataFrame, test: DataFrame, keys, levels, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Constant-width bands: calibration residuals give Q, test predictions get +-Q."""
    return normalized_conformal(cal.withColumn("_s", F.lit(1.0)), test.withColumn("_s", F.lit(1.0)), keys, levels,
                                "_s", hot_rows).drop("_s")


def normalized_conformal(cal: DataFrame, test: DataFrame, keys, levels, sigma: str,
                         hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Bands of width Q * sigma(x); scores are residuals over sigma."""
    from .ordered import value_counts
    s = cal.withColumn("_score", F.abs(F.col("y_true") - F.col("y_pred")) / F.col(sigma))
    c = value_counts(s, keys, "_score", hot_rows)   # ranked once for all levels
    aggs = []
    for i, lv in enumerate(levels):
        rank = F.ceil((F.col("tot") + 1).cast("double") * F.lit(float(lv)))
        hit = (F.col("cum") - F.col("n") < rank) & (rank <= F.col("cum"))
        aggs.append(F.coalesce(F.max(F.when(hit, F.col("_score"))), F.lit(float("inf"))).alias(f"_q{i}"))
    q = c.groupBy(*keys).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.col(f"_q{i}").alias("q")) for i, lv in enumerate(levels)])
    half = F.col("q") * F.col(sigma)
    d = attach(test, q.select(*keys, arr.alias("_q")), keys).select(*test.columns, F.inline("_q"))
    return d.withColumn("lower", F.col("y_pred") - half).withColumn("upper", F.col("y_pred") + half)


def residual_scale(resid: DataFrame, keys) -> DataFrame:
    """Sample standard deviation and mean absolute value of y_true - y_pred."""
    r = F.col("y_true") - F.col("y_pred")
    return resid.groupBy(*keys).agg(F.stddev_samp(r).alias("sigma_hat"), F.avg(F.abs(r)).alias("mean_abs"))


def ridge_with_scale(train: DataFrame, rows: DataFrame, keys, xs, y: str, lam: float = 1.0) -> DataFrame:
    """``rows`` with ``y_pred`` and ``sigma`` from two ridge fits on ``train`` per key.

    The second fit is of the absolute residuals of the first on the same design; its
    prediction is the scale, never below ``FLOOR_SHARE`` of their mean, so bands can be
    wider where residuals are larger and stay positive.  Keys without training rows
    have no predictions.
    """
    keys, xs = list(keys), list(xs)
    first = models.ridge(train, keys, xs, y, lam, penalise_intercept=False)
    resid = models.linear_predict(train, first, keys, xs, "_p").withColumn("_abs", F.abs(F.col(y) - F.col("_p")))
    second = models.ridge(resid, keys, xs, "_abs", lam, penalise_intercept=False)
    floor = resid.groupBy(*keys).agg((F.lit(FLOOR_SHARE) * (F.avg("_abs") + 1e-12)).alias("_floor"))
    coef = attach(attach(first.select(*keys, F.col("beta").alias("_b1")), second.select(*keys, F.col("beta").alias("_b2")), keys), floor, keys)

    def dot(beta: str):
        return reduce(lambda a, i: a + F.element_at(beta, i + 2) * F.col(xs[i]), range(len(xs)), F.element_at(beta, 1))
    return attach(rows, coef, keys).withColumn("y_pred", dot("_b1")).withColumn("sigma", F.greatest(dot("_b2"), "_floor")).drop("_b1", "_b2", "_floor")


def normal_theory(test: DataFrame, scale: DataFrame, keys, levels) -> DataFrame:
    """y_pred +- z * sigma_hat, one row per level."""
    lv = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(normal_z(v)).alias("z")) for v in levels]))
    d = attach(test, scale.select(*keys, "sigma_hat"), keys).withColumn("_l", lv)
    half = F.col("_l.z") * F.col("sigma_hat")
    return (d.withColumn("level", F.col("_l.level")).withColumn("lower", F.col("y_pred") - half)
            .withColumn("upper", F.col("y_pred") + half).drop("_l", "sigma_hat"))


def coverage(bands: DataFrame, by) -> DataFrame:
    """Closed-interval coverage, mean width and the gap to the nominal level."""
    inside = (F.col("y_true") >= F.col("lower")) & (F.col("y_true") <= F.col("upper"))
    return bands.groupBy(*by, "level").agg(
        F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"),
        F.count(F.lit(1)).alias("n")).withColumn("gap", F.abs(F.col("coverage") - F.col("level")))


def mean_gap(cov: DataFrame, by) -> DataFrame:
    return cov.groupBy(*by).agg(F.avg("gap").alias("mean_gap"))
