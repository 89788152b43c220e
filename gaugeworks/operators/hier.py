"""Hierarchical shrinkage of station means within networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .attach import attach

Z95 = 1.959963984540054


def sufficient_stats(df: DataFrame, keys, value: str) -> DataFrame:
    """n, mean and sample variance (0 for a single observation) per station."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("ybar"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("svar"))


def moment_hyper(suff: DataFrame, network) -> DataFrame:
    """mu, tau and sigma from station moments; tau and sigma at least 0.1."""
    floor = F.lit(0.1)
    return suff.groupBy(*network).agg(
        F.avg("ybar").alias("mu"),
        F.greatest(floor, F.coalesce(F.stddev_samp("ybar"), floor)).alias("tau"),
        F.greatest(floor, F.sqrt(F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("svar"))), F.lit(0.0)))).alias("sigma"))


def shrink(suff: DataFrame) -> DataFrame:
    """Normal-normal posterior of each station mean given columns mu, tau, sigma."""
    prec = 1.0 / (F.col("tau") * F.col("tau")) + F.col("n") / (F.col("sigma") * F.col("sigma"))
    mean = (F.col("mu") / (F.col("tau") * F.col("tau")) + F.col("n") * F.col("ybar") / (F.col("sigma") * F.col("sigma"))) / prec
    d = suff.withColumn("post_mean", mean).withColumn("post_sd", F.sqrt(1.0 / prec))
    return d.withColumn("lo95", F.col("post_mean") - Z95 * F.col("post_sd")).withColumn(
        "hi95", F.col("post_mean") + Z95 * F.col("post_sd"))


def empirical_bayes(df: DataFrame, network, station: str, value: str) -> DataFrame:
    """Sufficient statistics -> moment hyper-parameters per network -> posterior per station."""
    suff = sufficient_stats(df, [*network, station], value)
    return shrink(attach(suff, moment_hyper(suff, network), network))


def context_features(suff: DataFrame, network) -> DataFrame:
    """Per-station features with the context of the whole network."""
    n = F.col("n").cast("double")
    many = F.col("n") > 1
    ctx = suff.groupBy(*network).agg(
        F.avg("ybar").alias("_g"), F.coalesce(F.stddev_samp("ybar"), F.lit(0.0)).alias("_sb"),
        F.coalesce(F.sqrt(F.sum(F.when(many, F.col("svar") * (n - 1))) / F.greatest(F.lit(1.0), F.sum(F.when(many, n - 1)))),
                   F.lit(0.0)).alias("_sw"), F.count(F.lit(1)).alias("_s"))
    d = attach(suff, ctx, network)
    return d.withColumns({
        "dev": F.col("ybar") - F.col("_g"), "log1p_n": F.log1p("n"), "global_mean": F.col("_g"),
        "log_between": F.log(F.col("_sb") + 1e-6), "log_within": F.log(F.col("_sw") + 1e-6),
        "log1p_stations": F.log1p("_s")}).drop("_g", "_sb", "_sw", "_s")


def summarize_draws(draws: DataFrame, keys, value: str, hot_rows: int | None = None) -> DataFrame:
    """Mean, sample deviation and 2.5/97.5 % quantiles of posterior draws."""
    from .ordered import HOT_ROWS, quantiles
    q = quantiles(draws, keys, value, {"lo95": 0.025, "hi95": 0.975}, HOT_ROWS if hot_rows is None else hot_rows)
    m = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return m.join(q, list(keys))


def evaluate(posterior: DataFrame, truth: DataFrame, station, by=()) -> DataFrame:
    """Coverage, RMSE and mean width against the true station effects ``theta``."""
    j = posterior.join(truth, list(station))
    inside = (F.col("theta") >= F.col("lo95")) & (F.col("theta") <= F.col("hi95"))
    e = F.col("post_mean") - F.col("theta")
    return j.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"), F.sqrt(F.avg(e * e)).alias("rmse"),
                              F.avg(F.col("hi95") - F.col("lo95")).alias("width"), F.count(F.lit(1)).alias("n"))
