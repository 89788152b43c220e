"""Gap filling in time over chunks, and on grids by lower envelopes, against plain versions."""

import time

import numpy as np
import pandas as pd
import pytest

from gaugeworks.operators import profile, raster

RNG = np.random.default_rng(31)


@pytest.fixture(scope="module")
def series(spark):
    out = []
    for k, n, share in (("a", 400, 0.03), (None, 90, 0.3), ("empty", 50, 0.0), ("full", 20, 1.0)):
        v = np.where(RNG.random(n) < share, np.round(RNG.normal(size=n), 2), np.nan)
        out.append(pd.DataFrame({"k": k, "pos": np.arange(n), "v": v, "_from": 1}))
    pdf = pd.concat(out, ignore_index=True)
    rows = [(None if pd.isna(k) else k, int(p), None if np.isnan(v) else float(v)) for k, p, v in zip(pdf.k, pdf.pos, pdf.v)]
    return spark.createDataFrame(rows, "k string, pos long, v double").repartition(4), pdf


@pytest.mark.parametrize("chunk,gap", [(16, None), (7, 5), (65_536, None)])
def test_gaps_longer_than_a_chunk(series, chunk, gap):
    df, pdf = series
    for linear in (False, True):
        got = profile.gap_fill(df, ["k"], "pos", "v", linear=linear, max_gap=gap, chunk_rows=chunk).toPandas()
        assert got.columns.tolist() == ["k", "pos", "v", "filled"] and len(got) == len(pdf)
        for k, g in pdf.groupby("k", dropna=False):
            mine = (got[got.k.isna()] if pd.isna(k) else got[got.k == k]).sort_values("pos").filled.to_numpy()
            v, at = g.v.to_numpy(), np.flatnonzero(~np.isnan(g.v))
            want = v.copy()
            for i in np.flatnonzero(np.isnan(v)):
                b, a = at[at < i], at[at > i]
                if len(b) and (gap is None or i - b[-1] <= gap):
                    if not linear:
                        want[i] = v[b[-1]]
                    elif len(a) and (gap is None or a[0] - i <= gap):
                        want[i] = v[b[-1]] + (i - b[-1]) / (a[0] - b[-1]) * (v[a[0]] - v[b[-1]])
            np.testing.assert_allclose(mine, want, rtol=1e-12)


@pytest.mark.parametrize("dy,dx", [(1.0, 1.0), (2.0, 1.0), (0.7, 1.3)])
def test_nearest_valid_cell(spark, dy, dx):
    rows, want = [], {}
    for layer, share in (("dense", 0.4), ("sparse", 0.04), (None, 0.1), ("none", 0.0)):
        f = np.where(RNG.random((17, 23)) < share, np.arange(17 * 23).reshape(17, 23), np.nan)
        rows += [(layer, y, x, None if np.isnan(f[y, x]) else float(f[y, x])) for y in range(17) for x in range(23)]
        valid = np.argwhere(~np.isnan(f))
        for y in range(17):
            for x in range(23):
                best = min((((sy - y) * dy) * ((sy - y) * dy) + ((sx - x) * dx) * ((sx - x) * dx), sy, sx) for sy, sx in valid) if len(valid) else None
                want[layer, y, x] = float(f[best[1], best[2]]) if best else None
    df = spark.createDataFrame(rows, "layer string, iy int, ix int, value double").repartition(4)
    assert {(r["layer"], r["iy"], r["ix"]): r["value"] for r in raster.fill_nearest(df, ["layer"], dy, dx).collect()} == want


def test_a_row_of_a_whole_globe(spark):
    n = 43_200
    sy = np.where(RNG.random(n) < 0.3, RNG.integers(0, 21_600, n), -1)
    began = time.perf_counter()
    got = raster._row_sources(np.arange(n), sy, 10_000, 1.0, 1.0)
    assert time.perf_counter() - began < 10
    at = RNG.integers(0, n, 50)
    some = np.flatnonzero(sy >= 0)
    for x in at:
        d = (sy[some] - 10_000.0) ** 2 + (some - x) ** 2.0
        assert got[x] == some[np.lexsort((some, sy[some], d))[0]]
