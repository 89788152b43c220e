"""Catchment operators: wetness index, linear reservoir, routing, runoff design."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .series import CHUNK_ROWS, chunked, lag_columns, linear_scan


def api(df: DataFrame, keys, pos: str, precip: str, decay: float = 0.92, out: str = "api", shift: int = 1,
        restart: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Antecedent precipitation index, shifted so that a day's own rain is not in it.

    ``restart`` names a block column (for example a role) in which the index
    starts again from zero.
    """
    k = list(keys) + ([restart] if restart else [])
    d = linear_scan(df, k, pos, precip, F.lit(decay), decay, decay, out="_api", chunk_rows=chunk_rows)
    return lag_columns(d, k, pos, {out: ("_api", shift)}, chunk_rows).drop("_api")


def linear_reservoir(df: DataFrame, keys, pos: str, precip: str, flow: str, role: str = "role", n_grid: int = 12,
                     k_lo: float = 0.02, k_hi: float = 0.6, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Single linear reservoir: recession constant by train RMSE (first minimum), prediction on test.

    The recursion is linear, so storage is a scan from zero plus the decayed
    initial store (mean train flow); all trial constants run in one pass.
    """
    keys = list(keys)
    ks = [float(v) for v in np.linspace(k_lo, k_hi, n_grid)]
    s0 = df.filter(F.col(role) == "train").groupBy(*keys).agg(F.avg(flow).alias("_s0"))
    d = df.join(s0, keys).withColumn("_k", F.explode(F.array(*[F.lit(v) for v in ks])))
    d = linear_scan(d, keys + ["_k"], pos, precip, 1.0 - F.col("_k"), 1 - k_lo, 1 - k_hi, out="_scan", chunk_rows=chunk_rows)
    store = F.col("_scan") + F.pow(1.0 - F.col("_k"), F.col(pos) + 1) * F.col("_s0")
    d = d.withColumn("_q", F.col("_k") * store)
    err = F.sqrt(F.avg((F.col("_q") - F.col(flow)) * (F.col("_q") - F.col(flow))))
    best = (d.filter(F.col(role) == "train").groupBy(*keys, "_k").agg(err.alias("_e"))
            .groupBy(*keys).agg(F.min(F.struct("_e", "_k")).alias("_b")).select(*keys, F.col("_b._k").alias("_k")))
    return (d.filter(F.col(role) == "test").join(best, keys + ["_k"])
            .withColumn("y_true", F.col(flow)).withColumn("y_pred", F.greatest(F.col("_q"), F.lit(0.0)))
            .withColumnRenamed("_k", "k").drop("_s0", "_scan", "_q"))


def triangular_kernel(length: int, peak: int) -> list[float]:
    """Triangle through zero just before step 0 and just after the last, highest at ``peak``; scaled to sum one."""
    length = max(1, int(length))
    top = min(length - 1, max(0, int(peak)))
    height = np.interp(np.arange(length), [-1, top, length], [0.0, 1.0, 0.0])
    return (height / height.sum()).tolist()


def route(df: DataFrame, keys, pos: str, value: str, kernel, out: str = "routed", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Causal convolution with a routing kernel."""
    f = chunked(df, keys, pos, before=len(kernel) - 1, chunk_rows=chunk_rows)
    terms = [F.lit(float(w)) * F.coalesce(F.lag(value, j).over(f.window) if j else F.col(value), F.lit(0.0))
             for j, w in enumerate(kernel)]
    return f.select(**{out: sum(terms[1:], terms[0])})


def design(df: DataFrame, keys, pos: str, precip: str, n_lags: int = 7, temp: str | None = "temperature",
           pet: str | None = "pet", decay: float = 0.92, restart: str | None = None,
           chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """Lagged precipitation 0..n_lags, shifted wetness index, temperature and PET; warm-up rows dropped."""
    d = api(df, keys, pos, precip, decay, "api", 1, restart, chunk_rows)
    k = list(keys) + ([restart] if restart else [])
    specs = {f"p_lag{i}": (precip, i) for i in range(0, n_lags + 1)}
    d = lag_columns(d, k, pos, specs, chunk_rows)
    xs = list(specs) + ["api"] + [c for c in (temp, pet) if c]
    return d.dropna(subset=xs), xs


def linear_runoff(df: DataFrame, keys, pos: str, precip: str, flow: str, role: str = "role", n_lags: int = 7,
                  lam: float = 1e-6, **kw) -> DataFrame:
    """Normal-equation runoff model on the lagged design, clipped at zero on the test rows."""
    from . import models
    d, xs = design(df, keys, pos, precip, n_lags, **kw)
    coef = models.ols_gram(d.filter(F.col(role) == "train"), keys, xs, flow, lam)
    p = models.linear_predict(d.filter(F.col(role) == "test"), coef, keys, xs, "_p")
    return p.withColumn("y_true", F.col(flow)).withColumn("y_pred", F.greatest(F.col("_p"), F.lit(0.0))).drop("_p")
