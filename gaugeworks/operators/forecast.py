"""Baseline forecasters.  Each returns (keys..., ts, pos, method, horizon, y_true, y_pred)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import models
from .series import CHUNK_ROWS, chunked, lag_columns


def _contract(df: DataFrame, keys, ts: str, pos: str, value: str, method: str, h: int, pred) -> DataFrame:
    return df.select(*keys, ts, pos, F.lit(method).alias("method"), F.lit(h).alias("horizon"),
                     F.col(value).alias("y_true"), pred.alias("y_pred"))


def persistence(df: DataFrame, keys, ts: str, pos: str, value: str, h: int = 1, role: str | None = "role",
                clip: float | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The value ``h`` steps earlier; test rows only when a role column is given."""
    d = lag_columns(df, keys, pos, {"_p": (value, h)}, chunk_rows)
    if role:
        d = d.filter(F.col(role) == "test")
    pred = F.greatest(F.col("_p"), F.lit(clip)) if clip is not None else F.col("_p")
    return _contract(d, keys, ts, pos, value, "persistence", h, F.when(F.col("_p").isNotNull(), pred))


def seasonal_naive(df: DataFrame, keys, ts: str, pos: str, value: str, h: int = 1, period: int = 365,
                   role: str | None = "role", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The value one period earlier; before that y(t-h), and before that the first value."""
    f = chunked(df, keys, pos, before=max(period, h), chunk_rows=max(chunk_rows, period + h))
    # the first value is only reached for pos < h, which lies in the first chunk
    first = F.first(value).over(f.window)
    p = F.coalesce(F.lag(value, period).over(f.window), F.lag(value, h).over(f.window), first)
    d = f.select(_p=p)
    if role:
        d = d.filter(F.col(role) == "test")
    return _contract(d, keys, ts, pos, value, "seasonal_naive", h, F.col("_p"))


def ar_one_step(df: DataFrame, keys, ts: str, pos: str, value: str, n_lags: int = 6, role: str = "role",
                clip: float | None = 0.0, lam: float = 1e-6, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Linear AR(n_lags) fitted on the train rows, one step ahead from true lags."""
    xs = [f"_l{i}" for i in range(1, n_lags + 1)]
    d = lag_columns(df, keys, pos, {x: (value, i) for i, x in enumerate(xs, start=1)}, chunk_rows)
    coefs = models.ols_gram(d.filter(F.col(role) == "train"), keys, xs, value, lam)
    p = models.linear_predict(d.filter(F.col(role) == "test"), coefs, keys, xs, "_p")
    pred = F.greatest(F.col("_p"), F.lit(clip)) if clip is not None else F.col("_p")
    return _contract(p, keys, ts, pos, value, "linear_ar", 1, F.when(F.col("_p").isNotNull(), pred))


def ar_rolling(df: DataFrame, keys, ts: str, pos: str, value: str, h: int, n_lags: int, role: str = "role",
               max_train: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """AR(n_lags) fitted once on the last ``max_train`` train rows, recursed ``h`` steps.

    The forecast for t uses values up to t-h only.  The series is centred by the
    train mean, and the fit has no intercept beyond that mean.
    """
    tr = df.filter(F.col(role) == "train")
    if max_train:
        last = tr.groupBy(*keys).agg(F.max(pos).alias("_last"))
        tr = tr.join(last, list(keys)).filter(F.col(pos) > F.col("_last") - max_train).drop("_last")
    mean = tr.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.min(pos).alias("_from"), F.max(pos).alias("_to"))
    d = df.join(mean, list(keys)).withColumn("_c", F.col(value) - F.col("_mu"))
    f = chunked(d, keys, pos, before=n_lags + h, chunk_rows=chunk_rows)
    fit_lags = {f"_l{i}": F.lag("_c", i).over(f.window) for i in range(1, n_lags + 1)}
    ctx_lags = {f"_x{i}": F.lag("_c", h + i - 1).over(f.window) for i in range(1, n_lags + 1)}
    d = f.select(**fit_lags, **ctx_lags)
    xs = list(fit_lags)
    in_fit = (F.col(pos) >= F.col("_from") + n_lags) & (F.col(pos) <= F.col("_to"))
    coefs = models.ridge(d.filter(in_fit), keys, xs, "_c", 1e-9, penalise_intercept=False)
    t = d.filter(F.col(role) == "test").join(coefs.select(*keys, "beta"), list(keys))
    start = F.array(*[F.col(x) for x in ctx_lags])

    def step(lags, _):
        nxt = F.element_at("beta", 1) + F.aggregate(
            F.zip_with(F.slice("beta", 2, n_lags), lags, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
        return F.concat(F.array(nxt), F.slice(lags, 1, n_lags - 1)) if n_lags > 1 else F.array(nxt)

    final = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step)
    return _contract(t, keys, ts, pos, value, "autoreg", h, F.element_at(final, 1) + F.col("_mu"))


def ridge_lags(df: DataFrame, keys, ts: str, pos: str, value: str, h: int = 1, n_lags: int = 7, alpha: float = 1.0,
               role: str = "role", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ridge on lags h..h+n_lags-1 (direct h-step forecast)."""
    xs = [f"_l{i}" for i in range(n_lags)]
    d = lag_columns(df, keys, pos, {x: (value, h + i) for i, x in enumerate(xs)}, chunk_rows)
    coefs = models.ridge(d.filter(F.col(role) == "train"), keys, xs, value, alpha, penalise_intercept=False)
    p = models.linear_predict(d.filter(F.col(role) == "test"), coefs, keys, xs, "_p")
    return _contract(p, keys, ts, pos, value, "ridge", h, F.col("_p"))


BACKBONES = {"persistence": persistence, "seasonal_naive": seasonal_naive, "ar": ar_rolling, "ridge": ridge_lags}


def backbone(name: str):
    if name not in BACKBONES:
        raise ValueError(f"unknown backbone {name!r}; one of {sorted(BACKBONES)}")
    return BACKBONES[name]


def temperature_baselines(df: DataFrame, keys, ts: str, pos: str, value: str, horizons=(1, 7, 14), period: int = 365,
                          n_lags: int | None = None, role: str = "role", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Persistence and seasonal naive at every horizon from one window pass, plus rolling AR with ``n_lags``.

    All predictions of a row are stacked by an explode, so the series is read
    and sorted once however many horizons are asked for.
    """
    reach = max([period, *horizons])
    f = chunked(df, keys, pos, before=reach, chunk_rows=max(chunk_rows, reach))
    lag = lambda k: F.lag(value, k).over(f.window)
    first = F.first(value).over(f.window)
    cols = {"_season": lag(period)} | {f"_h{h}": lag(h) for h in horizons} | {"_first": first}
    d = f.select(**cols).filter(F.col(role) == "test")
    rows = []
    for h in horizons:
        rows.append(F.struct(F.lit("persistence").alias("method"), F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("y_pred")))
        rows.append(F.struct(F.lit("seasonal_naive").alias("method"), F.lit(h).alias("horizon"),
                             F.coalesce("_season", f"_h{h}", "_first").alias("y_pred")))
    out = d.select(*keys, ts, pos, F.col(value).alias("y_true"), F.explode(F.array(*rows)).alias("_r")).select(
        *keys, ts, pos, "_r.method", "_r.horizon", "y_true", "_r.y_pred")
    if n_lags:
        out = reduce(DataFrame.unionByName, [ar_rolling(df, keys, ts, pos, value, h, n_lags, role) for h in horizons], out)
    return out
