"""Distances of all pairs of places, reduced to counts and sums, without looking at most pairs.

Rows of one place come as one row with a weight, their number.
The rows of a key are cut into blocks along a Z-order curve, so a block is a
compact piece of the field, and a block into leaves of LEAF rows.  The boxes of two leaves bound
their distances; where both bounds fall into one bin, the pairs of the leaves count as a whole.
Only the other leaves are compared row by row.  A quantile is first enclosed by the
bounds alone, so its passes compare only leaves whose distances reach the enclosure.  Rounding keeps order in every
operation, so bounds and values agree to the last bit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import store
from . import blocks
from .attach import attach, null_safe
from .ordered import row_numbers

LEAF = 32
#: Rows of a block.
BLOCK_ROWS = 4_096
#: Pairs of leaves that are compared at a time: their distances stay in the cache.
SLAB = 64
#: Steps of the Z-order curve along each axis, in bits.
Z_BITS = 16
#: Bits of a value below those by which ``quantile`` first bins the bounds, and bits that each later pass settles.
FIRST, STEP = 44, 12
#: A range with at most this many pairs is settled in one more pass.
FEW = 1 << 16
_INF = np.float64(np.inf).view(np.int64)


def _spread(c):
    """The bits of a number below 2^16 with a zero bit before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def pack(df: DataFrame, keys, cols, id_col: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per (key, block) as :func:`blocks.pack`, each block a stretch of the Z-order curve; rows without a place are left out."""
    keys = list(keys)
    df = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    box = df.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    step = lambda c: F.coalesce(F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / F.nullif(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0)) * (1 << Z_BITS)),
                                        F.lit((1 << Z_BITS) - 1)), F.lit(0)).cast("long")
    coded = attach(df, box, keys).withColumn("_z", _spread(step("x")).bitwiseOR(F.shiftleft(_spread(step("y")), 1)))
    placed = row_numbers(coded, keys, ["_z", id_col], out="_rn", n="_n")
    blk = F.floor((F.col("_rn") - 1) / F.lit(block_rows)).cast("long")
    packed = placed.withColumns({"blk": blk, "nblk": F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("long")}).groupBy(*keys, "nblk", "blk").agg(
        F.collect_list(F.struct(*cols)).alias("_rows"))
    return packed.select(*keys, "nblk", "blk", *[F.transform("_rows", blocks._field(c)).alias(c) for c in cols])


class Leaves:
    """The rows of a block as leaves of LEAF rows (the last ones padded with nan), with their boxes; ``n`` adds up the weights ``w`` (1 if not given)."""

    def __init__(self, x, y, z=None, w=None, spread=None):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(x)
        strip = LEAF * max(1, int(np.ceil(np.sqrt(n / LEAF))))
        rank = np.empty(n, np.int64)
        rank[np.lexsort((y, x))] = np.arange(n)
        order = np.lexsort((x, y, rank // strip))
        fill = -n % LEAF
        shaped = lambda v, pad=np.nan: np.concatenate([v[order], np.full(fill, pad, v.dtype)]).reshape(-1, LEAF)
        self.x, self.y = shaped(x), shaped(y)
        self.x0, self.x1 = np.nanmin(self.x, 1), np.nanmax(self.x, 1)
        self.y0, self.y1 = np.nanmin(self.y, 1), np.nanmax(self.y, 1)
        w = np.ones(n, np.int64) if w is None else np.asarray(w, np.int64)
        self.single = bool((w == 1).all())
        self.w = shaped(w, 0)
        self.n = self.w.sum(1)
        if z is not None:
            z = np.asarray(z, float)
            self.sums = [shaped(v, 0.0) for v in (w.astype(float), w * z, w * z * z + (0.0 if spread is None else spread))]


def bounds(a: Leaves, b: Leaves):
    """Least and greatest possible distance of every leaf of a and every leaf of b."""
    gap = lambda lo, hi, lo2, hi2: np.maximum(np.maximum(lo2[None, :] - hi[:, None], lo[:, None] - hi2[None, :]), 0.0)
    far = lambda lo, hi, lo2, hi2: np.maximum(hi2[None, :] - lo[:, None], hi[:, None] - lo2[None, :])
    sides = (a.x0, a.x1, b.x0, b.x1), (a.y0, a.y1, b.y0, b.y1)
    return tuple(np.sqrt(f(*sides[0]) ** 2 + f(*sides[1]) ** 2) for f in (gap, far))


def compared(a: Leaves, b: Leaves, i, j, same: bool):
    """Distances of the rows of leaves ``i`` and ``j``, some pairs of leaves at a time: (i, j, distances); nan where there is no pair.

    Rows with weights also have a distance to themselves, that of the copies of their place.
    """
    upper = np.triu(np.ones((LEAF, LEAF), bool), int(a.single))
    for s in range(0, len(i), SLAB):
        p, q = i[s:s + SLAB], j[s:s + SLAB]
        d = np.sqrt((a.x[p][:, :, None] - b.x[q][:, None, :]) ** 2 + (a.y[p][:, :, None] - b.y[q][:, None, :]) ** 2)
        if same:
            own = np.flatnonzero(p == q)
            d[own] = np.where(upper, d[own], np.nan)
        yield p, q, d


def _weights(a: Leaves, b: Leaves, p, q, same: bool):
    """Pairs behind each distance of :func:`compared`; None if each is one pair."""
    if a.single and b.single:
        return None
    n = a.w[p][:, :, None] * b.w[q][:, None, :]
    if same:
        own, d = np.flatnonzero(p == q), np.arange(LEAF)
        n[own[:, None], d, d] = a.w[p[own]] * (a.w[p[own]] - 1) // 2
    return n


def _both(row):
    """Leaves of the two blocks of a pair, whether they are one block, and the pairs of leaves to count."""
    same = row.i == row.j
    a = Leaves(row.a_x, row.a_y, w=getattr(row, "a_w", None))
    b = a if same else Leaves(row.b_x, row.b_y, w=getattr(row, "b_w", None))
    todo = np.triu(np.ones((len(a.n), len(b.n)), bool)) if same else np.ones((len(a.n), len(b.n)), bool)
    return a, b, same, todo


def _pairs(a: Leaves, b: Leaves, same: bool) -> np.ndarray:
    """Pairs of rows in each pair of leaves."""
    n = a.n[:, None] * b.n[None, :]
    if same:
        np.fill_diagonal(n, a.n * (a.n - 1) // 2)
    return n


# ------------------------------------------------------------------ quantile

def _image(v: np.ndarray) -> np.ndarray:
    """The integers whose order is that of the distances (not below zero)."""
    return (np.asarray(v, float) + 0.0).view(np.int64)


def _enclose(row):
    """Pairs by the top bits of the bounds of their leaves: (bin, pairs whose least distance lies there, greatest)."""
    a, b, same, todo = _both(row)
    n = _pairs(a, b, same)[todo]
    ends = [_image(v[todo]) >> FIRST for v in bounds(a, b)]
    bins = np.unique(np.concatenate(ends))
    least, most = (np.bincount(np.searchsorted(bins, e), n, len(bins)).astype(np.int64) for e in ends)
    return {"bin": bins, "least": least, "most": most}


def _counts(row):
    """Pairs by bins of 2^shift images, for each range of ``row.asked``: (lo, bin, count); bin -1 holds those below the range."""
    a, b, same, todo = _both(row)
    n = _pairs(a, b, same)
    low, high = (_image(v) for v in bounds(a, b))
    out = []
    for lo, hi, shift in sorted((int(q["lo"]), int(q["hi"]), int(q["shift"])) for q in row.asked):
        hi = min(hi, int(_INF))
        below = todo & (high < lo)
        inside = todo & ~below & (low <= hi)
        one = inside & (low >= lo) & (high <= hi) & ((low - lo) >> shift == (high - lo) >> shift)
        under = int(n[below].sum())
        found = [(((low - lo) >> shift)[one], n[one])]
        first, last = (np.int64(v).view(float) for v in (lo, hi))
        for p, q, d in compared(a, b, *np.nonzero(inside & ~one), same):
            w, hit = _weights(a, b, p, q, same), (d >= first) & (d <= last)
            under += int(np.count_nonzero(d < first) if w is None else w[d < first].sum())
            v, at, c = np.unique((_image(d[hit]) - lo) >> shift, return_inverse=True, return_counts=True)
            found.append((v, c if w is None else np.bincount(at, w[hit], len(v)).astype(np.int64)))
        found.append((np.array([-1]), np.array([under])))
        bins, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        out.append((np.full(len(bins), lo), bins, np.bincount(at, np.concatenate([f[1] for f in found]), len(bins)).astype(np.int64)))
    return {k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("lo", "bin", "c"))}


def quantile(packed: DataFrame, keys, prob: float, out: str) -> DataFrame:
    """Exact ``prob`` quantile (linear interpolation) of the distances of all row pairs of a key.

    Keys of one block are answered inside their task.  For larger keys the bounds of
    the leaves enclose the two neighbouring order statistics; each pass then cuts their range into 4,096 until few
    pairs are left in it.  The state after each pass is a table in the shared folder.
    """
    keys = list(keys)
    packed = packed.select(*keys, "nblk", "blk", "x", "y", "w")

    def small(row):
        a, b, same, todo = _both(row)
        v, w = [], []
        for p, q, d in compared(a, b, *np.nonzero(todo), same):
            real = ~np.isnan(d)
            n = _weights(a, b, p, q, same)
            v.append(d[real])
            w.append(np.ones(len(v[-1]), np.int64) if n is None else n[real])
        v, w = np.concatenate(v), np.concatenate(w)
        order = np.argsort(v)
        upto = np.cumsum(w[order])
        if not len(upto) or not upto[-1]:
            return None
        h = (int(upto[-1]) - 1) * prob
        v0, v1 = (float(v[order[np.searchsorted(upto, i, "right")]]) for i in (np.floor(h), np.ceil(h)))
        return {out: [v0 + (h - np.floor(h)) * (v1 - v0)]}

    answer = blocks.reduce_pairs(blocks.self_pairs(packed.filter("nblk = 1"), keys), keys, small, f"{out} double")
    packed = packed.filter("nblk > 1")
    if not packed.limit(1).collect():
        return answer
    part = lambda *c: W.partitionBy(*keys, *c) if keys or c else W.partitionBy(F.lit(0))
    until = lambda *c: part(*c).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)

    pairs = blocks.self_pairs(packed, keys)
    ends = blocks.reduce_pairs(pairs, keys, _enclose, "bin long, least long, most long").groupBy(*keys, "bin").agg(
        F.sum("least").alias("least"), F.sum("most").alias("most"))                       # at most 2^(63 - FIRST) rows a key
    cum = ends.select(*keys, "bin", ((F.sum("least").over(part()) - 1) * F.lit(float(prob))).alias("h"),
                      F.sum("least").over(until()).alias("least"), F.sum("most").over(until()).alias("most"))
    state = cum.groupBy(*keys, "h").agg(F.min(F.when(F.col("least") > F.floor("h"), F.col("bin"))).alias("_a"),
                                        F.min(F.when(F.col("most") > F.ceil("h"), F.col("bin"))).alias("_b"))
    state = state.select(*keys, "h", F.shiftleft("_a", FIRST).alias("lo"), (F.shiftleft(F.col("_b") + 1, FIRST) - 1).alias("hi"), F.lit(None).cast("long").alias("c"),
                         F.posexplode(F.array(F.floor("h"), F.ceil("h"))).alias("side", "idx"))
    ks = [*keys, "side", "idx", "h", "lo", "hi", "shift"]
    while True:
        bits = F.greatest(F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))) - STEP, F.lit(0))
        state = store(state.withColumn("shift", F.when(F.col("c") <= FEW, 0).otherwise(bits).cast("int")).drop("c"), "pair-ranges")
        asked = state.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi", "shift")).alias("asked"))   # one or two
        counts = blocks.reduce_pairs(attach(pairs, asked, keys), keys, _counts, "lo long, bin long, c long").groupBy(*keys, "lo", "bin").agg(F.sum("c").alias("c"))
        bins = null_safe(state, counts, [*keys, "lo"]).withColumn("cum", F.sum("c").over(until(*ks[len(keys):])))   # at most 4 097 rows, or FEW + 1
        hit = (F.col("cum") - F.col("c") <= F.col("idx")) & (F.col("idx") < F.col("cum"))
        done = not state.agg(F.max("shift")).first()[0]
        state = bins.filter(hit).select(*keys, "side", "idx", "h", F.expr("lo + shiftleft(bin, shift)").alias("lo"),
                                        F.expr("lo + shiftleft(bin + 1, shift) - 1").alias("hi"), "c")
        if done:
            break

    def value(rows):
        for pdf in rows:
            yield pdf.assign(v=pdf["lo"].to_numpy(np.int64).view(float))[found.names]

    exact = state.select(*keys, "side", "h", "lo")
    found = T.StructType([*exact.schema.fields, T.StructField("v", T.DoubleType())])
    pair = exact.mapInPandas(value, found).groupBy(*keys, "h").agg(F.min_by("v", "side").alias("v0"), F.max_by("v", "side").alias("v1"))
    return answer.unionByName(pair.select(*keys, (F.col("v0") + (F.col("h") - F.floor("h")) * (F.col("v1") - F.col("v0"))).alias(out)))


# ------------------------------------------------------------------ variogram

@lru_cache(16)
def _edges(max_dist: float, n_bins: int) -> np.ndarray:
    """The least square of a distance that falls into bin 1, 2, ... or beyond; bisected, as the division rounds."""
    bins = np.arange(1, n_bins + 1)
    lo, hi = np.full(n_bins, -1, np.int64), np.full(n_bins, _INF)
    while (hi - lo > 1).any():
        mid = lo + (hi - lo) // 2
        reached = _bin(np.sqrt(np.maximum(mid, 0).view(float)), max_dist, n_bins) >= bins
        lo, hi = np.where(reached, lo, mid), np.where(reached, mid, hi)
    return hi.view(float)


def _bin(d, max_dist: float, n_bins: int):
    """Number of the right-open bin of a distance, ``n_bins`` from ``max_dist`` on."""
    return np.where(d < max_dist, np.minimum(np.floor(d / (max_dist / n_bins)), n_bins), n_bins).astype(np.int64)


def squared_by_bin(packed: DataFrame, keys, limit: DataFrame, n_bins: int) -> DataFrame:
    """Pairs and sums of half the squared differences of ``z`` by distance bin: (bin, n, g); rows without ``z`` are left out.

    A row stands for ``zw`` values at its place with mean ``z`` and sum ``zz`` of squared deviations from it.

    ``limit`` has one row per key with ``max_dist``; the bins are right-open and equal.
    Pairs are counted from each bin on: two leaves count as a whole up to the bin of their least distance,
    and by comparing their rows with the edges up to the bin of their greatest.
    """
    keys = list(keys)

    def kernel(row):
        if not row.max_dist / n_bins > 0:
            return None
        a_z, b_z = np.asarray(row.a_z, float), np.asarray(row.b_z, float)
        ka, kb = ~np.isnan(a_z), ~np.isnan(b_z)
        if not (ka.any() and kb.any()):
            return None
        middle = (a_z[ka].mean() + b_z[kb].mean()) / 2
        leaves = lambda x, y, z, w, zz, k: Leaves(np.asarray(x, float)[k], np.asarray(y, float)[k], z[k] - middle, np.asarray(w)[k], np.asarray(zz, float)[k])
        a = leaves(row.a_x, row.a_y, a_z, row.a_zw, row.a_zz, ka)
        same = row.i == row.j
        b = a if same else leaves(row.b_x, row.b_y, b_z, row.b_zw, row.b_zz, kb)
        pairs = _pairs(a, b, same)
        todo = np.triu(np.ones(pairs.shape, bool)) if same else np.ones(pairs.shape, bool)
        first, last = (_bin(v, row.max_dist, n_bins) for v in bounds(a, b))
        todo &= first < n_bins
        s1, s2 = ([v.sums[k].sum(1) for v in (a, b)] for k in (1, 2))
        half = 0.5 * (b.n[None, :] * s2[0][:, None] + a.n[:, None] * s2[1][None, :]) - s1[0][:, None] * s1[1][None, :]
        if same:
            np.fill_diagonal(half, half.diagonal() / 2)
        from_on = lambda v: np.bincount(first[todo], v[todo], n_bins + 1)[::-1].cumsum()[::-1]
        n, g = from_on(pairs).astype(np.int64), from_on(half)
        i, j = np.nonzero(todo & (last > first))
        order = np.argsort(first[i, j], kind="stable")
        i, j = i[order], j[order]
        edges = np.concatenate([[0.0], _edges(float(row.max_dist), n_bins)])
        right = np.stack(b.sums, -1)
        upper = np.triu(np.ones((LEAF, LEAF), bool), 1)
        for s in range(0, len(i), SLAB):
            p, q = i[s:s + SLAB], j[s:s + SLAB]
            d2 = (a.x[p][:, :, None] - b.x[q][:, None, :]) ** 2 + (a.y[p][:, :, None] - b.y[q][:, None, :]) ** 2
            if same:
                own = np.flatnonzero(p == q)
                d2[own] = np.where(upper, d2[own], np.nan)
            f, l = first[p, q], last[p, q]
            for k in range(f.min() + 1, l.max() + 1):
                at = np.flatnonzero((f < k) & (k <= l))
                if len(at):
                    reach = (d2 if len(at) == len(d2) else d2[at]) >= edges[k]
                    count, one, two = np.moveaxis(reach.astype(float) @ right[q[at]], -1, 0)
                    w, z, zz = (v[p[at]] for v in a.sums)
                    n[k] += int((w * count).sum())
                    g[k] += 0.5 * ((zz * count).sum() + (w * two).sum()) - (z * one).sum()
        n, g = n[:-1] - n[1:], g[:-1] - g[1:]
        hit = np.flatnonzero(n)
        return {"bin": hit, "n": n[hit], "g": np.maximum(g[hit], 0.0)}

    pairs = attach(blocks.self_pairs(packed, keys), limit, keys)
    part = blocks.reduce_pairs(pairs, keys, kernel, "bin int, n long, g double")
    return part.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
