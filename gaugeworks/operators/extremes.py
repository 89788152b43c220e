"""Extreme-value indices, return levels and their checks.

A *block table* has one row per key and block (year), so its groups are as long
as the record, whatever the number of observations behind them; raw daily rows
are reduced by partial aggregation before anything is ordered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import stats
from ..functions.scalars import is_finite, md5_int
from .attach import attach, null_safe
from .features import rolling
from .ordered import HOT_ROWS, quantiles, row_numbers

EULER = 0.5772156649015329


def annual_maxima(df: DataFrame, keys, ts: str, value: str, out: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.max(value).alias(out))


def rx5day(df: DataFrame, keys, pos: str, ts: str, value: str, width: int = 5) -> DataFrame:
    """Annual maximum of the trailing 5-day sum, by the year of the window's end."""
    r = rolling(df, keys, pos, value, width, "sum", "_r", include_current=True)
    return r.groupBy(*keys, F.year(ts).alias("year")).agg(F.max("_r").alias("value")).filter(F.col("value").isNotNull())


def r95p(df: DataFrame, keys, ts: str, value: str, prob: float = 0.95, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Annual sum of days strictly above the record-wide wet-day percentile; 0 in years without one."""
    thr = quantiles(df.filter(F.col(value) > 0), keys, value, {"_thr": prob}, hot_rows)
    d = null_safe(df, thr, keys, "left") if keys else attach(df, thr, [])
    return d.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.sum(F.when(F.col(value) > F.col("_thr"), F.col(value)).otherwise(0.0)).alias("value"))


def threshold(df: DataFrame, keys, value: str, quantile: float = 0.9, out: str = "threshold",
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exceedance threshold: exact quantile of the observed values."""
    return quantiles(df, keys, value, {out: quantile}, hot_rows)


def empirical_return_level(bm: DataFrame, keys, value: str, periods, hot_rows: int | None = None) -> DataFrame:
    """Quantile 1 - 1/T of the block maxima, one row per period."""
    names = {f"_t{i}": 1.0 - 1.0 / t for i, t in enumerate(periods)}
    q = quantiles(bm, keys, value, names, hot_rows)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("period"), F.col(f"_t{i}").alias("level"))
                      for i, t in enumerate(periods)])
    return q.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.period", "r.level")


def _lmoment_params(b0: Column, b1: Column, b2: Column) -> dict[str, Column]:
    l1, l2 = b0, 2 * b1 - b0
    t3 = (6 * b2 - 6 * b1 + b0) / l2
    c = 2.0 / (3.0 + t3) - F.lit(float(np.log(2) / np.log(3)))
    k = 7.8590 * c + 2.9554 * c * c
    gumbel = F.abs(k) < 1e-9
    g = stats.gamma(1.0 + k)
    s = F.when(gumbel, l2 / float(np.log(2))).otherwise(l2 * k / ((1.0 - F.pow(F.lit(2.0), -k)) * g))
    loc = F.when(gumbel, l1 - EULER * s).otherwise(l1 - s * (1.0 - g) / k)
    return {"c": F.when(gumbel, 0.0).otherwise(k), "loc": loc, "scale": s}


def gev_fit(bm: DataFrame, keys, value: str, hot_rows: int | None = None, order=None) -> DataFrame:
    """GEV parameters by L-moments (closed form): c (= -xi), xi, loc, scale, nll, n; needs 3 blocks.

    ``order`` names a column that breaks ties between equal maxima.
    """
    keys = list(keys)
    x = F.col(value)
    d = row_numbers(bm.filter(is_finite(x)), keys, [value] + list(order or []), out="_i", n="_n", hot_rows=hot_rows)
    i, n = F.col("_i").cast("double"), F.col("_n").cast("double")
    w1 = (i - 1) / (n - 1)
    w2 = w1 * (i - 2) / (n - 2)
    mom = d.filter(F.col("_n") >= 3).groupBy(*keys).agg(
        F.avg(x).alias("b0"), F.avg(w1 * x).alias("b1"), F.avg(w2 * x).alias("b2"), F.max("_n").alias("n"))
    return mom.select(*keys, *[c.alias(a) for a, c in _lmoment_params(F.col("b0"), F.col("b1"), F.col("b2")).items()],
                      "n").withColumn("xi", -F.col("c"))


def gev_nll(bm: DataFrame, fit: DataFrame, keys, value: str) -> DataFrame:
    """Negative log-likelihood of fitted parameters; +infinity outside the support."""
    j = attach(bm.filter(is_finite(F.col(value))), fit.select(*keys, "c", "loc", "scale"), keys)
    z = (F.col(value) - F.col("loc")) / F.col("scale")
    c, t = F.col("c"), 1.0 - F.col("c") * z
    ll = (F.when(c == 0, -F.log("scale") - z - F.exp(-z))
          .when(t > 0, -F.log("scale") + (1.0 / c - 1.0) * F.log(t) - F.pow(t, 1.0 / c))
          .otherwise(F.lit(float("-inf"))))
    return j.groupBy(*keys).agg((-F.sum(ll)).alias("nll"))


def gev_return_level(c: Column, loc: Column, scale: Column, period: Column) -> Column:
    y = -F.log(1.0 - 1.0 / period)
    return F.when(c == 0, loc - scale * F.log(y)).otherwise(loc + scale / c * (1.0 - F.pow(y, c)))


def return_levels(fit: DataFrame, keys, periods) -> DataFrame:
    d = fit.withColumn("period", F.explode(F.array(*[F.lit(float(t)) for t in periods])))
    return d.select(*keys, "period", gev_return_level(F.col("c"), F.col("loc"), F.col("scale"), F.col("period")).alias("level"))


def return_curve(fit: DataFrame, keys, lo: float = 2.0, hi: float = 200.0, n: int = 60) -> DataFrame:
    """Return levels at ``n`` log-spaced periods."""
    step = (np.log(hi) - np.log(lo)) / (n - 1)
    period = F.exp(F.lit(float(np.log(lo))) + F.col("i") * F.lit(float(step)))
    d = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("period", period)
    return d.select(*keys, "i", "period", gev_return_level(F.col("c"), F.col("loc"), F.col("scale"), F.col("period")).alias("level"))


def _nll(theta, x):
    c, loc, scale = theta
    if scale <= 0:
        return np.inf
    z = (x - loc) / scale
    if abs(c) < 1e-12:
        v = len(x) * np.log(scale) + np.sum(z + np.exp(-z))
    else:
        t = 1.0 - c * z
        if np.any(t <= 0):
            return np.inf
        lt = np.log(t)
        v = len(x) * np.log(scale) + np.sum((1.0 - 1.0 / c) * lt + np.exp(lt / c))
    return v if np.isfinite(v) else np.inf


def _simplex_min(f, start, scale, iters=2000, tol=1e-9):
    """Downhill simplex for three parameters."""
    pts = np.vstack([start, start + np.diag(scale)])
    vals = np.array([f(p) for p in pts])
    for _ in range(iters):
        o = np.argsort(vals, kind="stable")
        pts, vals = pts[o], vals[o]
        if vals[-1] - vals[0] < tol and np.max(np.abs(pts - pts[0])) < 1e-7:
            break
        mid = pts[:-1].mean(axis=0)
        far = pts[-1] - mid
        trial = {r: mid - r * far for r in (1.0, 2.0, 0.5, -0.5)}
        fr = f(trial[1.0])
        if fr < vals[0]:
            fe = f(trial[2.0])
            pts[-1], vals[-1] = (trial[2.0], fe) if fe < fr else (trial[1.0], fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = trial[1.0], fr
        else:
            r = 0.5 if fr < vals[-1] else -0.5
            fc = f(trial[r])
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = trial[r], fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                vals[1:] = [f(p) for p in pts[1:]]
    return pts[0], vals[0]


def gev_mle(bm: DataFrame, keys, value: str) -> DataFrame:
    """Maximum-likelihood GEV per key (simplex from Gumbel moments, c = 0.1).

    One group is one block table of a key: as many values as years on record.
    """
    keys = list(keys)
    d = bm.filter(is_finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_x"))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("c", "loc", "scale", "nll")]
                          + [T.StructField("n", T.LongType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["_x"].to_numpy()
        if len(x) < 3:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        s0 = max((np.std(x, ddof=1) or 1.0) * np.sqrt(6) / np.pi, 1e-3)
        best = None
        for c0 in (0.1, -0.1, 0.01):
            p, v = _simplex_min(lambda th: _nll(th, x), np.array([c0, x.mean() - EULER * s0, s0]),
                                np.array([0.05, 0.1 * s0, 0.1 * s0]))
            if best is None or v < best[1]:
                best = (p, v)
        (c, loc, scale), v = best
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "c": [c], "loc": [loc], "scale": [scale],
                             "nll": [v], "n": [len(x)]})

    return d.groupBy(*keys).applyInPandas(fit, schema)


def bootstrap_ci(bm: DataFrame, keys, value: str, periods, n_boot: int = 500, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of GEV return levels over resampled block tables.

    Each key's sorted maxima form one array (a value per year); every replicate
    draws indices from md5 digests, so the result does not depend on
    partitioning.  Replicates are refitted by L-moments, spread over the cluster
    by (key, replicate).
    """
    keys = list(keys)
    sorted_bm = bm.filter(is_finite(F.col(value))).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    reps = (sorted_bm.withColumn("_n", F.size("_v")).filter(F.col("_n") >= 3)
            .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))))
    key_text = [F.col(k).cast("string") for k in keys]
    draw = lambda i: md5_int(F.concat_ws("|", *key_text, F.col("rep").cast("string"), i.cast("string"), F.lit(str(seed)))) % F.col("_n")
    idx = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.element_at("_v", (draw(i) + 1).cast("int")))
    r = reps.select(*keys, "rep", "_n", F.array_sort(idx).alias("_s"))
    n = F.col("_n").cast("double")
    mean = lambda wt: F.aggregate(F.zip_with("_s", F.sequence(F.lit(1), F.col("_n")), lambda x, i: x * wt(i.cast("double"))),
                                  F.lit(0.0), lambda a, v: a + v) / n
    r = r.select(*keys, "rep", mean(lambda i: F.lit(1.0)).alias("b0"), mean(lambda i: (i - 1) / (n - 1)).alias("b1"),
                 mean(lambda i: (i - 1) * (i - 2) / ((n - 1) * (n - 2))).alias("b2"))
    r = r.filter(2 * F.col("b1") - F.col("b0") > 1e-12)   # a constant resample has no fit
    fit = r.select(*keys, "rep", *[c.alias(a) for a, c in _lmoment_params(F.col("b0"), F.col("b1"), F.col("b2")).items()])
    lv = return_levels(fit, keys + ["rep"], periods).filter(is_finite(F.col("level")))
    # n_boot values per (key, period): a fixed-size group
    ci = lv.groupBy(*keys, "period").agg(
        F.percentile("level", F.lit(alpha / 2)).alias("_lo"), F.percentile("level", F.lit(1 - alpha / 2)).alias("_hi"),
        F.count(F.lit(1)).alias("n_ok"))
    point = return_levels(gev_fit(bm, keys, value), keys, periods)
    j = point.join(ci, keys + ["period"], "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0).cast("long")))
    few = F.col("n_ok") < 2
    return j.select(*keys, "period", "level", F.when(few, F.col("level")).otherwise(F.col("_lo")).alias("lo"),
                    F.when(few, F.col("level")).otherwise(F.col("_hi")).alias("hi"), "n_ok")


def plotting_positions(bm: DataFrame, keys, value: str, order, hot_rows: int | None = None) -> DataFrame:
    """Gringorten position and return period of each ranked maximum."""
    d = row_numbers(bm, keys, [value] + list(order), out="rank", n="_n", hot_rows=hot_rows)
    p = (F.col("rank") - 0.44) / (F.col("_n") + 0.12)
    return d.withColumn("position", p).withColumn("return_period", 1.0 / (1.0 - F.col("position"))).drop("_n")


def validate(checks: DataFrame, n_tests: int, min_blocks: int = 20, autocorr_warn: float = 0.3) -> DataFrame:
    """Sign-off checks on (n, p_value, r1, xi): warning labels, notes and a pass flag.

    ``checks`` holds one row per key, joined from the fit, the trend test and
    the autocorrelation.
    """
    r1_bad = F.col("r1").isNotNull() & (F.abs("r1") > autocorr_warn)
    rules = [("few_blocks", "blocks_ok", F.col("n") < min_blocks),
             ("trend_in_maxima", "stationary", F.coalesce(F.col("p_value"), F.lit(1.0)) < 0.05),
             ("autocorrelated", "independent", r1_bad),
             ("extreme_shape", "shape_ok", F.abs("xi") > 0.5)]
    warn = F.array_compact(F.array(*[F.when(bad, w) for w, _, bad in rules]))
    note = F.array_compact(F.array(*[F.when(~bad, n) for _, n, bad in rules],
                                   F.when(F.lit(n_tests > 1), F.lit("bonferroni"))))
    return (checks.withColumn("warnings", warn).withColumn("notes", note)
            .withColumn("passed", F.size("warnings") == 0)
            .withColumn("bonferroni_alpha", F.lit(0.05 / max(n_tests, 1))))


def peaks_over_threshold(df: DataFrame, keys, pos: str, value: str, thr: Column, gap: int, chunk_rows: int = 65_536) -> DataFrame:
    """Declustered exceedances: one peak per run of exceedances closer than ``gap`` steps.

    A cluster starts where no exceedance lies in the ``gap`` steps before; the
    cluster number is a running count, carried across chunks.
    """
    from .ordered import running
    from .series import chunked
    d = df.withColumn("_x", F.when(F.col(value) > thr, 1))
    f = chunked(d, keys, pos, before=gap, chunk_rows=chunk_rows)
    d = f.select(_near=F.count("_x").over(f.rows(-gap, -1))).filter(F.col("_x") == 1)
    d = running(d, keys, [pos], {"cluster": ("sum", F.when(F.col("_near") == 0, 1).otherwise(0).cast("long"))},
                bucket=F.floor(F.col(pos) / chunk_rows))
    return d.groupBy(*keys, "cluster").agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n_steps"),
                                           F.min(pos).alias("start_pos"))
