"""Image-band arrays and gridded fields.

Patches keep one row per patch with one array per band; pixel arithmetic uses
array functions, so nothing is exploded or shuffled.  Gridded fields are long
(key..., iy, ix, value) tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .attach import attach
from .ordered import HOT_ROWS, value_counts

EPS = 1e-6
BANDS = ("blue", "green", "red", "nir", "swir")


def _dbl(a) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return _total(_dbl(a)) / F.size(a)


def mean_ratio(a: str, b: str) -> Column:
    """Mean over pixels of (a - b) / (a + b + eps)."""
    r = F.zip_with(_dbl(F.col(a)), _dbl(F.col(b)), lambda u, v: (u - v) / (u + v + EPS))
    return _total(r) / F.size(a)


def spectral_indices(df: DataFrame) -> DataFrame:
    """Mean NDVI, NDWI and SWIR, and brightness over all bands and pixels."""
    bright = sum((_total(_dbl(F.col(b))) for b in BANDS[1:]), _total(_dbl(F.col(BANDS[0])))) / (5 * F.size("red"))
    return df.withColumns({"ndvi": mean_ratio("nir", "red"), "ndwi": mean_ratio("green", "nir"),
                           "swir_mean": array_mean(F.col("swir")), "brightness": bright})


def patch_ndvi(df: DataFrame, out: str = "ndvi") -> DataFrame:
    return df.withColumn(out, mean_ratio("nir", "red"))


def ndvi_drop(t0: DataFrame, t1: DataFrame, on) -> DataFrame:
    """NDVI at t0 minus NDVI at t1 per patch; only the reduced index is shuffled."""
    a = patch_ndvi(t0, "ndvi0").select(*on, "ndvi0")
    b = patch_ndvi(t1, "ndvi1").select(*on, "ndvi1")
    return a.join(b, list(on)).withColumn("drop", F.col("ndvi0") - F.col("ndvi1"))


def detect_change(drops: DataFrame, threshold: Column) -> DataFrame:
    return drops.withColumn("pred", (F.col("drop") >= threshold).cast("int"))


def rank_change(drops: DataFrame, tie: str, limit: int | None = None) -> DataFrame:
    out = drops.orderBy(F.desc("drop"), tie)
    return out.limit(limit) if limit else out


def best_threshold(df: DataFrame, keys, diff: str, changed: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Threshold with the largest macro F1 (prediction: diff >= threshold), lowest on ties.

    Candidates are the midpoints between distinct differences and one step
    outside each end.  Running counts replace the scan over candidates.
    """
    from .ordered import running
    keys = list(keys)
    dist = df.groupBy(*keys, diff).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(changed)).alias("pos"))
    c = running(dist, keys, [diff], {"cn": ("sum", F.col("n")), "cp": ("sum", F.col("pos"))}, totals=True, hot_rows=hot_rows)

    def f1(tp, fp, fn):
        return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    def macro(cn, cp):
        p, n = F.col("tot_cp"), F.col("tot_cn")
        tp1, fn1, tn = p - cp, cp, cn - cp
        fp1 = (n - p) - tn
        has1, has0 = (p > 0) | (cn < n), (p < n) | (cn > 0)
        one, zero = f1(tp1, fp1, fn1), f1(tn, fn1, fp1)
        return (F.when(has1, one).otherwise(0.0) + F.when(has0, zero).otherwise(0.0)) / (has1.cast("int") + has0.cast("int"))

    # candidate "above value v" for every v, and "below everything" at the smallest v
    above = c.select(*keys, F.col(diff).alias("v"), F.lit(1).alias("side"), macro(F.col("cn"), F.col("cp")).alias("f1"))
    lowest = c.groupBy(*keys).agg(F.min(diff).alias("v"), F.max(diff).alias("_hi"), F.max("tot_cn").alias("tot_cn"),
                                  F.max("tot_cp").alias("tot_cp"))
    zero = F.lit(0).cast("long")
    below = lowest.select(*keys, "v", F.lit(0).alias("side"), macro(zero, zero).alias("f1"))
    pick = (above.unionByName(below).groupBy(*keys)
            .agg(F.min(F.struct((-F.round("f1", 12)).alias("nf"), F.col("v"), F.col("side"), F.col("f1"))).alias("b")))
    pick = pick.select(*keys, F.col("b.v").alias("_v"), F.col("b.side").alias("_side"), F.col("b.f1").alias("macro_f1"))
    joined = attach(c.select(*keys, diff), pick, keys)
    nxt = joined.groupBy(*keys, "_v", "_side", "macro_f1").agg(
        F.min(F.when(F.col(diff) > F.col("_v"), F.col(diff))).alias("_next"), F.count(F.lit(1)).alias("_d"))
    thr = (F.when(F.col("_d") == 1, F.col("_v")).when(F.col("_side") == 0, F.col("_v") - 1e-3)
           .when(F.col("_next").isNull(), F.col("_v") + 1e-3).otherwise((F.col("_v") + F.col("_next")) / 2.0))
    return nxt.select(*keys, thr.alias("threshold"), "macro_f1")


def rescale(df: DataFrame, bands, scale: float = 1.0, offset: float = 0.0, stats: dict | None = None) -> DataFrame:
    """v * scale + offset per pixel, then an optional fixed (mean, sd) per band."""
    def conv(b):
        m, s = (stats or {}).get(b, (0.0, 1.0))
        return F.transform(b, lambda v: (v.cast("double") * scale + offset - m) / s)
    return df.withColumns({b: conv(b) for b in bands})


# ---------------------------------------------------------------- gridded fields

def grid_corners(grid: DataFrame, keys) -> DataFrame:
    """One row per grid cell with its four corner values (each node serves four cells)."""
    parts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    d = grid.withColumn("_c", F.explode(parts))
    at = lambda dx, dy: F.max(F.when((F.col("_c.dx") == dx) & (F.col("_c.dy") == dy), F.col("value")))
    d = d.withColumn("cx", F.col("ix") - F.col("_c.dx")).withColumn("cy", F.col("iy") - F.col("_c.dy"))
    return d.groupBy(*keys, "cx", "cy").agg(at(0, 0).alias("f00"), at(1, 0).alias("f10"), at(0, 1).alias("f01"), at(1, 1).alias("f11"))


def sample_bilinear(points: DataFrame, grid: DataFrame, keys, x: str, y: str, axes: dict, out: str = "sampled") -> DataFrame:
    """Bilinear value of a regular grid at each point, clamped at the edges.

    ``axes`` = x0, dx, nx, y0, dy, ny.  Corners are gathered once per cell on
    the grid side, so points are joined once and never multiplied.
    """
    u = (F.col(x) - axes["x0"]) / axes["dx"]
    v = (F.col(y) - axes["y0"]) / axes["dy"]
    clip = lambda e, hi: F.greatest(F.lit(0).cast("long"), F.least(F.floor(e), F.lit(hi).cast("long")))
    p = points.withColumn("cx", clip(u, axes["nx"] - 2)).withColumn("cy", clip(v, axes["ny"] - 2))
    frac = lambda e, c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e - F.col(c)))
    p = p.withColumn("_tx", frac(u, "cx")).withColumn("_ty", frac(v, "cy"))
    cells = grid_corners(grid, keys)
    cells = cells.withColumn("cx", F.col("cx").cast("long")).withColumn("cy", F.col("cy").cast("long"))
    j = p.join(cells, list(keys) + ["cx", "cy"])
    tx, ty = F.col("_tx"), F.col("_ty")
    term = lambda w, f: F.when(w > 0, w * F.col(f)).otherwise(0.0)
    val = (term((1 - tx) * (1 - ty), "f00") + term(tx * (1 - ty), "f10") + term((1 - tx) * ty, "f01") + term(tx * ty, "f11"))
    return j.withColumn(out, val).drop("cx", "cy", "_tx", "_ty", "f00", "f10", "f01", "f11")


def sample_nearest(points: DataFrame, grid: DataFrame, keys, x: str, y: str, axes: dict, out: str = "sampled") -> DataFrame:
    """Value of the nearest node of a regular grid (halves round up), clamped at the edges."""
    idx = lambda e, hi: F.greatest(F.lit(0), F.least(F.floor(e + 0.5), F.lit(hi))).cast("long")
    p = (points.withColumn("ix", idx((F.col(x) - axes["x0"]) / axes["dx"], axes["nx"] - 1))
         .withColumn("iy", idx((F.col(y) - axes["y0"]) / axes["dy"], axes["ny"] - 1)))
    g = grid.select(*keys, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("value").alias(out))
    return p.join(g, list(keys) + ["ix", "iy"]).drop("ix", "iy")


def regrid_bilinear(grid: DataFrame, keys, src: dict, dst: dict, wrap_lon: bool = False) -> DataFrame:
    """Interpolate whole fields to another regular grid, clamped at the edges; ``wrap_lon`` closes the circle."""
    keys = list(keys)
    if wrap_lon:
        first = grid.filter(F.col("ix") == 0).withColumn("ix", F.lit(src["nx"]).cast(grid.schema["ix"].dataType))
        grid, src = grid.unionByName(first), {**src, "nx": src["nx"] + 1}
    # the target cells of each field come from an exploded cell number
    fields = grid.select(*keys).distinct() if keys else grid.sparkSession.range(1).select(F.lit(0).alias("_g"))
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dst["nx"] * dst["ny"] - 1).cast("long")))
    target = fields.withColumn("_t", cell)
    target = target.withColumn("tx", F.col("_t") % dst["nx"]).withColumn("ty", F.floor(F.col("_t") / dst["nx"]))
    target = target.withColumn("x", dst["x0"] + F.col("tx") * dst["dx"]).withColumn("y", dst["y0"] + F.col("ty") * dst["dy"])
    return sample_bilinear(target, grid, keys, "x", "y", src, "value").select(*keys, "ty", "tx", "value")


def _axis_overlap(spark, src0, dsrc, nsrc, dst0, ddst, ndst, prefix, sphere):
    """(target index, source index, weight): overlap of regular cell edges, by arithmetic instead of a range join."""
    t = spark.range(ndst).withColumnRenamed("id", f"t{prefix}")
    lo = dst0 + F.col(f"t{prefix}") * ddst
    hi = lo + ddst
    first = F.greatest(F.lit(0).cast("long"), F.floor((lo - src0) / dsrc))
    last = F.least(F.lit(nsrc - 1).cast("long"), F.ceil((hi - src0) / dsrc) - 1)
    t = t.withColumn("_lo", lo).withColumn("_hi", hi).filter(first <= last).withColumn(f"i{prefix}", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("_lo"), src0 + F.col(f"i{prefix}") * dsrc)
    b = F.least(F.col("_hi"), src0 + (F.col(f"i{prefix}") + 1) * dsrc)
    w = F.sin(F.radians(b)) - F.sin(F.radians(a)) if sphere else b - a
    return t.select(f"t{prefix}", f"i{prefix}", w.alias(f"w{prefix}")).filter(F.col(f"w{prefix}") > 0)


def regrid_conservative(grid: DataFrame, keys, src: dict, dst: dict, sphere: bool = True) -> DataFrame:
    """Area-weighted regrid; ``x0``/``y0`` are lower cell edges; NULL cells are skipped.

    Latitude weights are sine differences.  The two weight tables are as long
    as a grid axis.
    """
    spark = grid.sparkSession
    wx = _axis_overlap(spark, src["x0"], src["dx"], src["nx"], dst["x0"], dst["dx"], dst["nx"], "x", False)
    wy = _axis_overlap(spark, src["y0"], src["dy"], src["ny"], dst["y0"], dst["dy"], dst["ny"], "y", sphere)
    g = grid.filter(F.col("value").isNotNull()).join(wy, "iy").join(wx, "ix")
    # source cells collapse to target cells map-side before the shuffle
    w = F.col("wx") * F.col("wy")
    return g.groupBy(*keys, "ty", "tx").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def _row_sources(ix: np.ndarray, sy: np.ndarray, iy: int, dy: float, dx: float) -> np.ndarray:
    """For each cell of a row the place of the column whose nearest valid cell is nearest (-1 without any).

    ``sy`` is the row of each column's nearest valid cell, negative where it has none; ``ix``
    rises.  The squared distances to the columns are parabolas; their lower envelope
    takes one step a column.  Parabolas that only touch it stay in, so ties are decided
    by the distances themselves: least, then smaller row, then column.
    """
    some = np.flatnonzero(sy >= 0)
    if not len(some):
        return np.full(len(ix), -1)
    x = ix[some] * dx
    height = ((sy[some] - iy) * dy) ** 2 + x * x
    slack = 1e-9 * (1 + np.abs(x).max())
    on, begin = [], []
    for q, (a, h) in enumerate(zip(x.tolist(), height.tolist())):
        start = -np.inf
        while on:
            start = (h - on[-1][2]) / (2 * (a - on[-1][1]))
            if start >= begin[-1] - slack:
                break
            on.pop()
            begin.pop()
            start = -np.inf
        on.append((q, a, h))
        begin.append(start)
    places, at = some[[o[0] for o in on]], np.maximum.accumulate(begin)
    cells = ix * dx
    first = np.maximum(np.searchsorted(at, cells - slack, "left") - 1, 0)
    last = np.maximum(np.searchsorted(at, cells + slack, "right") - 1, first)
    best, rank = places[first], None
    for step in range(int((last - first).max()) + 1):
        c = places[np.minimum(first + step, last)]
        gy, gx = (sy[c] - iy) * dy, (ix[c] - ix) * dx
        now = gy * gy + gx * gx, sy[c], ix[c]
        if rank is None:
            best, rank = c, now
            continue
        less = (now[0] < rank[0]) | ((now[0] == rank[0]) & ((now[1] < rank[1]) | ((now[1] == rank[1]) & (now[2] < rank[2]))))
        best, rank = np.where(less, c, best), tuple(np.where(less, a, b) for a, b in zip(now, rank))
    return best


def fill_nearest(grid: DataFrame, keys, dy: float = 1.0, dx: float = 1.0) -> DataFrame:
    """Fill missing cells from the nearest valid cell (ties: smaller row, then column).

    Exact and separable: the nearest valid cell up or down each column, then the
    best over the columns of each row, by a lower envelope in linear time.  A group is
    one column or one row of a field, never a whole field.  A field without a valid
    cell stays empty.
    """
    keys = list(keys)
    col = W.partitionBy(*keys, "ix").orderBy("iy")
    hit = F.when(F.col("value").isNotNull(), F.struct(F.col("iy").alias("sy"), F.col("value").alias("v")))
    up = F.last(hit, ignorenulls=True).over(col.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(hit, ignorenulls=True).over(col.rowsBetween(0, W.unboundedFollowing))
    d = grid.withColumn("_u", up).withColumn("_d", down)
    near = F.when(F.col("_u").isNull(), F.col("_d")).when(F.col("_d").isNull(), F.col("_u")) \
        .when(F.col("iy") - F.col("_u.sy") <= F.col("_d.sy") - F.col("iy"), F.col("_u")).otherwise(F.col("_d"))
    d = d.withColumn("_s", near)
    cell = F.struct("ix", F.coalesce(F.col("_s.sy").cast("long"), F.lit(-1)).alias("sy"), F.col("_s.v").alias("v"))
    rows = d.groupBy(*keys, "iy").agg(F.sort_array(F.collect_list(cell)).alias("_r"))

    @F.pandas_udf("array<int>")
    def sources(iy: pd.Series, ix: pd.Series, sy: pd.Series) -> pd.Series:
        return pd.Series([_row_sources(np.asarray(x, np.int64), np.asarray(s, np.int64), int(y), dy, dx) for y, x, s in zip(iy, ix, sy)])

    pick = lambda c: F.transform("_r", lambda r: r[c])
    rows = rows.withColumn("_from", sources("iy", pick("ix"), pick("sy")))
    filled = F.transform("_r", lambda r, i: F.struct(r["ix"].alias("ix"), F.get("_r", F.get("_from", i))["v"].alias("value")))
    return rows.select(*keys, "iy", F.explode(filled).alias("_o")).select(*keys, "iy", "_o.ix", "_o.value")
