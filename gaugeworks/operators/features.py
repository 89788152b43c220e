"""Feature frames over dense series (see :mod:`series` for ``pos`` and chunking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars
from .attach import attach
from .series import CHUNK_ROWS, chunked, lag_columns


def calendar(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(scalars.calendar(F.col(ts)))


def lags(df: DataFrame, keys, pos: str, value: str, n_lags: int, *, reset_by: str | None = None,
         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns ``<value>_lag1..n``; NULL where history is missing.

    ``reset_by`` (for example a split role) starts a new history in each block.
    """
    k = list(keys) + ([reset_by] if reset_by else [])
    return lag_columns(df, k, pos, {f"{value}_lag{i}": (value, i) for i in range(1, n_lags + 1)}, chunk_rows)


def rolling(df: DataFrame, keys, pos: str, value: str, width: int, agg: str, out: str, *,
            include_current: bool, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Trailing ``sum``/``avg``/``max``/``min`` over ``width`` rows, NULL until ``width`` values exist."""
    lo, hi = (-(width - 1), 0) if include_current else (-width, -1)
    f = chunked(df, keys, pos, before=width, chunk_rows=chunk_rows)
    frame = f.rows(lo, hi)
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[agg]
    return f.select(**{out: F.when(F.count(value).over(frame) == width, fn(value).over(frame))})


def nowcast_frame(df: DataFrame, keys, pos: str, ts: str, target: str, covariates, *, n_lags: int = 6,
                  rolls=(3, 6, 12), cov_lags: int = 2, covariates_now: bool = True,
                  chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """Target lags, trailing means, covariate lags and time-of-day/week cycles in one window pass.

    Returns the frame and the list of feature names (21 with the defaults and
    three covariates).
    """
    reach = max([n_lags, cov_lags, *rolls])
    f = chunked(df, keys, pos, before=reach, chunk_rows=chunk_rows)
    cols: dict[str, Column] = {f"{target}_lag{k}": F.lag(target, k).over(f.window) for k in range(1, n_lags + 1)}
    for w in rolls:
        fr = f.rows(-w, -1)
        cols[f"{target}_roll{w}"] = F.when(F.count(target).over(fr) == w, F.avg(target).over(fr))
    for c in covariates:
        for k in range(0 if covariates_now else 1, cov_lags + 1):
            cols[f"{c}_lag{k}"] = F.lag(c, k).over(f.window) if k else F.col(c)
    out = f.select(**cols)
    cycles = {**scalars.cyclical(F.hour(ts), 24, "hour"), **scalars.cyclical(F.weekday(ts), 7, "dow")}
    return out.withColumns(cycles), list(cols) + list(cycles)


def complete_cases(df: DataFrame, cols) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def finite(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.filter(scalars.is_finite(F.col(c)))
    return df


def standardize(df: DataFrame, keys, cols, train: Column, eps: float = 1e-8) -> DataFrame:
    """``<c>_z`` = (x - mean) / (population sd + eps), both taken from the train rows."""
    stats = df.filter(train).groupBy(*keys).agg(
        *[a for c in cols for a in (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])
    return attach(df, stats, keys).withColumns({f"{c}_z": (F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + eps) for c in cols}) \
        .drop(*[f"_{s}_{c}" for c in cols for s in ("mu", "sd")])


def windows(df: DataFrame, keys, pos: str, cols, target: str, lookback: int, horizon: int = 1,
            stride: int = 1, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Supervised windows: ``x`` = array of structs over ``lookback`` rows, ``y`` = target
    ``horizon`` rows after the window's last row (0 = on it).  One row per window,
    labelled with the position ``target_pos`` of its target."""
    f = chunked(df, keys, pos, before=lookback, after=horizon, chunk_rows=chunk_rows)
    y = F.lead(target, horizon).over(f.window) if horizon else F.col(target)
    out = f.select(x=F.collect_list(F.struct(*cols)).over(f.rows(-(lookback - 1), 0)), y=y)
    out = out.withColumn("target_pos", F.col(pos) + horizon).filter((F.size("x") == lookback) & F.col("y").isNotNull())
    if stride > 1:
        out = out.filter(F.col("target_pos") % stride == 0)
    return out.select(*keys, "target_pos", "x", "y")


def resample(df: DataFrame, keys, ts: str, unit: str, values) -> DataFrame:
    return (df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias(ts))
            .agg(*[F.avg(v).alias(v) for v in values]))


def resample_join(left: DataFrame, right: DataFrame, keys, ts: str, unit: str, left_values, right_values) -> DataFrame:
    """Average two sources to one time step and join them; both sides shuffle on the same key."""
    return resample(left, keys, ts, unit, left_values).join(
        resample(right, keys, ts, unit, right_values), list(keys) + [ts])


def slice_shift(df: DataFrame, keys, pos: str, ts: str, start, end, step: int, shifted: dict[str, int],
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every ``step``-th row of a time range; ``shifted`` columns take the value k rows earlier."""
    out = lag_columns(df, keys, pos, {f"{c}_shift": (c, k) for c, k in shifted.items()}, chunk_rows)
    return out.filter(F.col(ts).between(F.lit(start), F.lit(end)) & (F.col(pos) % step == 0))
