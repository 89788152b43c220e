"""Trend tests over block series (one row per key and block, ``order`` = step index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..session import store
from .attach import attach
from .inversions import GROUP_ROWS, concordance, slope_quantiles
from .ordered import HOT_ROWS, quantiles
from .series import chunked


def _pairs(df: DataFrame, keys, order: str, value: str, group_rows: int) -> DataFrame:
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    return concordance(d, keys, "t", ["y"], group_rows=group_rows)


def mann_kendall(df: DataFrame, keys, order: str, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """S, continuity-corrected z, two-sided p and n per key; the variance carries the tie term.

    S is counted in n log n (see :mod:`inversions`); a key above ``group_rows`` rows is split.
    """
    keys = list(keys)
    s = _pairs(df, keys, order, value, group_rows).select(*keys, (F.col("up") - F.col("down")).alias("s"))
    ties = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
            .groupBy(*keys).agg(F.sum("c").alias("n"),
                                F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("_tie")))
    n = F.col("n").cast("double")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_tie")) / 18.0
    z = F.when(var <= 0, 0.0).otherwise((F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(var))
    return (attach(s, ties, keys).withColumn("z", z).withColumn("p_value", stats.two_sided_p(F.col("z")))
            .select(*keys, "s", "z", "p_value", "n"))


def pair_counts(df: DataFrame, keys, order: str, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number of time-ordered pairs and of pairs in which the later value is larger."""
    keys = list(keys)
    steps = df.filter(F.col(value).isNotNull() & F.col(order).isNotNull()).groupBy(*keys, order).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    pairs = steps.groupBy(*keys).agg(F.floor((n * n - F.sum(F.col("c") * F.col("c"))) / 2).cast("long").alias("n_pairs"))
    up = _pairs(df, keys, order, value, group_rows).select(*keys, F.col("up").alias("n_up"))
    return attach(pairs, up, keys)


def sen_slope(df: DataFrame, keys, order: str, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Median of all pairwise slopes per step, selected without forming the pairs (see :mod:`inversions`)."""
    return slope_quantiles(df, keys, order, value, 0.5, "sen_slope", group_rows)


def sen_line(df: DataFrame, keys, order: str, value: str, group_rows: int = GROUP_ROWS,
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Slope and the median intercept of ``value - slope * order``."""
    keys = list(keys)
    slope = sen_slope(df, keys, order, value, group_rows)
    resid = attach(df, slope, keys).withColumn("_r", F.col(value) - F.col("sen_slope") * F.col(order))
    return attach(slope, quantiles(resid, keys, "_r", {"intercept": 0.5}, hot_rows), keys)


def lag1_autocorr(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Correlation with the previous block; NULL below three blocks, 0 if either side is constant.

    ``order`` is a dense step index starting at 0.
    """
    f = chunked(df, keys, order, before=1)
    d = f.select(_prev=F.lag(value, 1).over(f.window))
    cur = F.when(F.col("_prev").isNotNull(), F.col(value))
    flat = (F.stddev_pop(cur) == 0) | (F.stddev_pop("_prev") == 0)
    r = F.when(F.count(value) < 3, F.lit(None).cast("double")).when(flat, 0.0).otherwise(F.corr(cur, "_prev"))
    return d.groupBy(*keys).agg(r.alias("r1"))


def table(indices: dict[str, DataFrame], keys, order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Trend test and slope for several block indices with the Bonferroni threshold.

    The indices are stacked first, so the test runs once over (index, key).
    """
    from functools import reduce
    stacked = reduce(DataFrame.unionByName, [
        d.select(F.lit(name).alias("index_name"), *keys, order, value) for name, d in indices.items()])
    stacked = store(stacked, "trend")   # a row per key and year, read several times below
    k = ["index_name", *keys]
    thr = alpha / len(indices)
    return (attach(mann_kendall(stacked, k, order, value), sen_slope(stacked, k, order, value), k)
            .withColumn("bonferroni_alpha", F.lit(thr)).withColumn("significant", F.col("p_value") < thr))


def benjamini_hochberg(df: DataFrame, keys, p: str, q: float = 0.05) -> DataFrame:
    """False-discovery-rate adjusted p-values (running minimum of p*m/rank from the largest p).

    Works on distinct p-values with counts, so ties share the largest rank.
    """
    from .ordered import running, value_counts
    c = value_counts(df, keys, p).withColumn("_raw", F.least(F.col(p) * F.col("tot") / F.col("cum"), F.lit(1.0)))
    c = c.withColumn("_neg", -F.col(p))
    adj = running(c, keys, ["_neg"], {"p_adj": ("min", F.col("_raw"))})
    out = adj.select(*keys, p, "p_adj")
    return df.join(out, [*keys, p]).withColumn("reject", F.col("p_adj") <= q)


def residual_diagnostics(df: DataFrame, keys, pos: str, value: str, m: int) -> DataFrame:
    """Autocorrelations at lags 1..m, Ljung-Box Q and Durbin-Watson of a residual series."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    f = chunked(df.join(mean, list(keys)).withColumn("_e", F.col(value) - F.col("_mu")), keys, pos, before=m)
    d = f.select(**{f"_l{k}": F.lag("_e", k).over(f.window) for k in range(1, m + 1)})
    e2 = F.sum(F.col("_e") * F.col("_e"))
    acf = [(F.sum(F.col("_e") * F.col(f"_l{k}")) / e2).alias(f"acf{k}") for k in range(1, m + 1)]
    diff = F.col("_e") - F.col("_l1")
    out = d.groupBy(*keys).agg(F.count(value).alias("n"), (F.sum(diff * diff) / e2).alias("durbin_watson"), *acf)
    n = F.col("n").cast("double")
    q = sum((F.col(f"acf{k}") * F.col(f"acf{k}") / (n - k) for k in range(2, m + 1)),
            F.col("acf1") * F.col("acf1") / (n - 1))
    return out.withColumn("ljung_box", n * (n + 2) * q)
