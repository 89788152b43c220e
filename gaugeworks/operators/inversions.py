"""Counting ordered pairs in n log n: concordance of two orders, and slopes by their dual lines.

Of all row pairs of a key, those in which the later row is larger are the pairs
that are not inverted.  A group that fits in a task is counted there by merges.  A
larger key is cut twice, into ranges of its order and into ranges of its values;
a pair then lies in one range of the order (counted there), in one range of the values
but two of the order (counted there, by range number), or in two of both, which only
the numbers of rows in each crossing of ranges decide.  Those numbers are a smaller
problem of the same kind.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import store
from .attach import attach, null_safe
from .blocks import reduce_pairs
from .ordered import with_range_bucket

#: Rows of a key that one task may hold.
GROUP_ROWS = 1 << 19
#: Up to this many rows, all slopes of a key are written out.
FEW_ROWS = 600


def _levels(n: int):
    size = 1
    while size < n:
        yield size
        size *= 2


def _halves(rank: np.ndarray, size: int):
    """Sorted blocks of ``size`` as neighbouring left and right halves: keys (pair number first) and places of both."""
    at = np.arange(len(rank))
    key = (at // (2 * size)) * (int(rank.max()) + 2) + rank
    right = (at // size) % 2 == 1
    return key, np.flatnonzero(~right), np.flatnonzero(right)


def smaller_before(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight[i] * weight[j] over i < j with rank[i] < rank[j] (ranks from 0)."""
    total, rank, weight = 0, rank.astype(np.int64), weight.astype(np.int64)
    for size in _levels(len(rank)):
        key, left, right = _halves(rank, size)
        upto = np.concatenate([[0], np.cumsum(weight[left])])
        first = key[right] - rank[right]                      # least key of the pair
        below = upto[np.searchsorted(key[left], key[right], "left")] - upto[np.searchsorted(key[left], first, "left")]
        total += int((below * weight[right]).sum())
        order = np.argsort(key, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def inverted_pairs(rank: np.ndarray):
    """Places (i, j), i < j, with rank[i] > rank[j], as two arrays."""
    first, second = [], []
    rank, place = rank.astype(np.int64), np.arange(len(rank))
    for size in _levels(len(rank)):
        key, left, right = _halves(rank, size)
        lo = np.searchsorted(key[left], key[right], "right")
        hi = np.searchsorted(key[left], key[right] - rank[right] + int(rank.max()) + 1, "left")
        n = hi - lo
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first.append(place[left][np.repeat(lo, n) + within])
        second.append(place[right][np.repeat(np.arange(len(right)), n)])
        order = np.argsort(key, kind="stable")
        rank, place = rank[order], place[order]
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, int), np.empty(0, int))


def dense_rank(*columns: np.ndarray) -> np.ndarray:
    """Rank from 0 by the columns in turn; equal rows share a rank."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def up_and_down(order, values, weight) -> tuple[int, int]:
    """Weighted pairs of different ``order`` in which the later value is larger, and smaller."""
    t, v, w = dense_rank(np.asarray(order)), dense_rank(*map(np.asarray, values)), np.asarray(weight, np.int64)
    line = np.lexsort((-v, t))                                # of one order, larger values first: no pair of them counts
    up = smaller_before(v[line], w[line])

    def same(r):
        n = np.bincount(r, w)
        return int((n.astype(object) ** 2).sum()) if n.max(initial=0) > 2e7 else int((n * n).sum())
    cell = dense_rank(t, v)
    n = int(w.sum())
    differ, level = (n * n - same(t)) // 2, (same(v) - same(cell)) // 2
    return up, differ - level - up


def _counted(groups: DataFrame, keys, values) -> DataFrame:
    """``up, down`` of each group row, which holds arrays of order, weight and each value."""
    def kernel(row):
        up, down = up_and_down(row.t_, [getattr(row, f"arr_{i}") for i in range(len(values))], row.w_)
        return {"up": [up], "down": [down]}
    return reduce_pairs(groups, keys, kernel, "up long, down long")


def _grouped(df: DataFrame, keys, order: str, values, extra) -> DataFrame:
    cols = {"t_": order, **{f"arr_{i}": v for i, v in enumerate(values)}, "w_": "_w"}
    rows = df.groupBy(*keys, *extra).agg(F.collect_list(F.struct(*cols.values())).alias("_r"))
    pick = lambda c: (lambda r: r[c])
    return rows.select(*keys, *[F.transform("_r", pick(c)).alias(a) for a, c in cols.items()])


def concordance(df: DataFrame, keys, order: str, values, weight: Column | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``up`` and ``down`` per key: row pairs of different ``order`` whose later row is larger, and smaller, in ``values``.

    ``values`` lists columns that are compared in turn.  Rows with a null in
    ``order`` or ``values`` take no part.  Each row counts ``weight`` times (1).
    """
    keys, values = list(keys), list(values)
    if not keys:
        return concordance(df.withColumn("nokey", F.lit(0)), ["nokey"], order, values, weight, group_rows).drop("nokey")
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [order, *values]])
    d = df.where(there).groupBy(*keys, order, *values).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("_w"))
    d, split = with_range_bucket(d, keys, [order], group_rows)
    parts = [_counted(_grouped(d, keys, order, values, ["_bucket"]), keys, values)]
    if split:
        several = d.groupBy(*keys).agg(F.max("_bucket").alias("_b"), F.min("_bucket").alias("_a")).where("_a < _b").select(*keys)
        hot = null_safe(d, several, keys, "left_semi").withColumnRenamed("_bucket", "_range")
        hot = hot.groupBy(*keys, "_range", *values).agg(F.sum("_w").alias("_w"))
        hot, _ = with_range_bucket(hot, keys, values, group_rows)
        hot = store(hot, "concordance")                       # read by both parts below
        parts.append(_counted(_grouped(hot, keys, "_range", values, ["_bucket"]), keys, values))
        cells = hot.groupBy(*keys, "_range", "_bucket").agg(F.sum("_w").alias("_n")).withColumnRenamed("_bucket", "_value")
        parts.append(concordance(cells, keys, "_range", ["_value"], F.col("_n"), 2 * group_rows))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


# ------------------------------------------------------------------ slopes

_LOW_BITS = np.int64(0x7FFF_FFFF_FFFF_FFFF)
_SPLITTER = 134_217_729.0
#: Slopes are searched between plus and minus this, over the largest order.
_MOST = 1e290


def image(v):
    """The integers whose order is that of the doubles."""
    b = (np.asarray(v, float) + 0.0).view(np.int64)
    return b ^ ((b >> 63) & _LOW_BITS)


def from_image(x):
    x = np.asarray(x, np.int64)
    return (x ^ ((x >> 63) & _LOW_BITS)).view(float) + 0.0


def dual(t, y, slope):
    """``y - slope * t`` as an unevaluated sum of two doubles (error-free product and sum)."""
    p = slope * t
    a, b = _SPLITTER * slope, _SPLITTER * t
    sh, th = a - (a - slope), b - (b - t)
    sl, tl = slope - sh, t - th
    e = ((sh * th - p) + sh * tl + sl * th) + sl * tl
    s = y - p
    v = s - y
    r = (y - (s - v)) + (-p - v)
    low = r - e
    hi = s + low
    return hi, low - (hi - s)


class Slopes:
    """Order statistics of (y[j] - y[i]) / (t[j] - t[i]) over pairs of different t, without the pairs."""

    def __init__(self, t: np.ndarray, y: np.ndarray):
        self.t, self.y = t, y
        self.rank_t, self.one = dense_rank(t), np.ones(len(t), np.int64)
        per = np.bincount(self.rank_t)
        self.pairs = (len(t) ** 2 - int((per.astype(np.int64) ** 2).sum())) // 2
        r = np.random.default_rng(7)
        i, j = r.integers(0, len(t), 4096), r.integers(0, len(t), 4096)
        ok = t[i] != t[j]
        self.found = (0, np.empty(0))      # a stretch of slopes written out, and how many lie below it
        self.trials = np.unique((y[j] - y[i])[ok] / (t[j] - t[i])[ok])

    def upto(self, slope: float) -> int:
        """Number of slopes at or below ``slope``: pairs whose dual lines have met."""
        z = dense_rank(*dual(self.t, self.y, slope))
        line = np.lexsort((-z, self.rank_t))
        return self.pairs - smaller_before(z[line], self.one)

    def between(self, lo: float, hi: float) -> np.ndarray:
        """The slopes above ``lo`` up to ``hi``, sorted: lines that change places between the two."""
        line = np.lexsort((self.y, -self.t, *dual(self.t, self.y, lo)[::-1]))
        rank = dense_rank(*dual(self.t, self.y, hi), -self.t)[line]
        i, j = (line[p] for p in inverted_pairs(rank))
        return np.sort((self.y[j] - self.y[i]) / (self.t[j] - self.t[i]))

    def at(self, k: int) -> float:
        """The k-th smallest slope (from 0): trials first, then bits, then the few that are left."""
        if 0 <= k - self.found[0] < len(self.found[1]):
            return float(self.found[1][k - self.found[0]])
        most = _MOST / max(1.0, np.abs(self.t).max())
        lo, hi, below, upto = -most, most, 0, self.pairs
        tried = self.trials
        while int(image(hi)) - int(image(lo)) > 1:
            if upto - below <= 8 * len(self.t):
                self.found = (below, self.between(lo, hi))
                return float(self.found[1][k - below])
            tried = tried[(tried > lo) & (tried < hi)]
            # twice, the place expected of k in a sorted sample and its error on the far side; then the middle
            if len(tried) > 400:
                place = len(tried) * (k - below) / (upto - below)
                step = 3 * np.sqrt(len(tried)) / 2
                place = place - step if lo == -most else place + step if hi == most else len(tried) / 2
                slope = tried[int(np.clip(place, 0, len(tried) - 1))]
            elif len(tried):
                slope = tried[len(tried) // 2]
            else:
                slope = float(from_image((int(image(lo)) + int(image(hi))) // 2))
            if not lo < slope < hi:      # only the second zero lies between
                break
            n = self.upto(slope)
            if n > k:
                hi, upto = slope, n
            else:
                lo, below = slope, n
        return float(hi)


def slope_quantile(t, y, prob: float) -> float | None:
    """Linearly interpolated quantile of all pair slopes of one series; None without a pair."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    if len(t) <= FEW_ROWS:
        i, j = np.triu_indices(len(t), 1)
        ok = t[i] != t[j]
        return float(np.quantile((y[j] - y[i])[ok] / (t[j] - t[i])[ok], prob)) if ok.any() else None
    s = Slopes(t, y)
    if not s.pairs:
        return None
    h = (s.pairs - 1) * prob
    k = int(np.floor(h))
    low = s.at(k)
    return low if h == k else low + (h - k) * (s.at(k + 1) - low)


#: Trial slopes of a key and pass where a key is larger than a task: each pass settles this many bits.
TRIAL_BITS = 4


def slope_quantiles(df: DataFrame, keys, order: str, value: str, prob: float, out: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Quantile of the slopes of all row pairs of different ``order``, per key.

    Keys up to ``group_rows`` rows (at least ``FEW_ROWS``) are answered in one task.  For
    larger keys, both neighbouring order statistics are settled over the bits,
    ``TRIAL_BITS`` a pass, by counting with ``concordance``; the state after each pass is
    a table in the shared folder.  The result is then the smallest double not below
    the true slope.  Keys without a pair have no row.
    """
    keys, one_task = list(keys), max(group_rows, FEW_ROWS)
    if not keys:
        return slope_quantiles(df.withColumn("nokey", F.lit(0)), ["nokey"], order, value, prob, out, group_rows).drop("nokey")
    d = df.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(
        *keys, F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    sized = attach(d, d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    field = lambda c: (lambda r: r[c])
    small = sized.where(F.col("_n") <= one_task).groupBy(*keys).agg(F.collect_list(F.struct("t", "y")).alias("_r")).select(
        *keys, F.transform("_r", field("t")).alias("t_"), F.transform("_r", field("y")).alias("y_"))

    def kernel(row):
        v = slope_quantile(row.t_, row.y_, prob)
        return None if v is None else {out: [v]}

    answer = reduce_pairs(small, keys, kernel, f"{out} double")
    big = sized.where(F.col("_n") > one_task).select(*keys, "t", "y")
    if not big.limit(1).collect():
        return answer
    return answer.unionByName(_large(store(big, "slopes"), keys, prob, out, group_rows))


def _large(rows: DataFrame, keys, prob: float, out: str, group_rows: int) -> DataFrame:
    per = rows.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("_same"), F.max(F.abs("t")).alias("_t"))
    bits = F.pandas_udf(lambda v: pd.Series(image(v)), "long")
    value = F.pandas_udf(lambda x: pd.Series(from_image(x)), "double")
    pairs = F.floor((F.col("n") * F.col("n") - F.col("_same")) / 2).cast("long")
    per = per.withColumn("pairs", pairs).where("pairs > 0").withColumn("_h", (F.col("pairs") - 1) * F.lit(float(prob)))
    edge = bits(F.lit(_MOST) / F.greatest(F.lit(1.0), F.col("_t")))
    per = per.select(*keys, "pairs", "_h", edge.alias("hi")).withColumn("lo", -F.col("hi") - 1)
    state = store(per.withColumn("idx", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))), "slope-state")

    @F.pandas_udf("zh double, zl double")
    def line(t: pd.Series, y: pd.Series, slope: pd.Series) -> pd.DataFrame:
        hi, low = dual(t.to_numpy(), y.to_numpy(), slope.to_numpy())
        return pd.DataFrame({"zh": hi + 0.0, "zl": low + 0.0})

    n = 1 << TRIAL_BITS
    for _ in range(-(-64 // TRIAL_BITS)):
        lo, hi = F.col("lo").cast("decimal(38,0)"), F.col("hi").cast("decimal(38,0)")
        steps = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(lo + (hi - lo) * i / n).cast("long"))
        inside = F.array_distinct(F.filter(steps, lambda x: (x > F.col("lo")) & (x < F.col("hi"))))
        trials = state.select(*keys, F.explode(inside).alias("x")).distinct().withColumn("slope", value("x"))
        tried = attach(rows, trials.groupBy(*keys).agg(F.collect_list(F.struct("x", "slope")).alias("_s")), keys)
        tried = tried.withColumn("_s", F.explode("_s")).withColumn("_z", line("t", "y", F.col("_s.slope"))).select(*keys, "t", F.col("_s.x").alias("x"), "_z.*")
        met = concordance(tried, [*keys, "x"], "t", ["zh", "zl"], group_rows=group_rows).drop("down")
        both = null_safe(state, met, keys, "left")
        upto = F.col("pairs") - F.col("up")
        passed = upto > F.col("idx")
        state = store(both.groupBy(*keys, "pairs", "_h", "idx").agg(
            F.greatest(F.max("lo"), F.max(F.when(~passed, F.col("x")))).alias("lo"), F.least(F.min("hi"), F.min(F.when(passed, F.col("x")))).alias("hi")), "slope-state")
    found = state.withColumn("v", value("hi")).groupBy(*keys, "_h").agg(F.min_by("v", "idx").alias("_a"), F.max_by("v", "idx").alias("_b"))
    return found.select(*keys, (F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a"))).alias(out))
