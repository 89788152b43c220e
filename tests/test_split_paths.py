"""The paths for hot keys give the same answers as one window or one array per key.

Every test forces many small ranges, chunks or blocks on a table in which one
key holds a third of the rows or more.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import blocks, extremes, features, intervals, metrics, raster, series, spatial, splits, trend
from gaugeworks.operators.ordered import average_ranks, order_statistic, quantiles, row_numbers, running

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def skewed(spark):
    n = {"a": 900, "b": 40, "c": 7, "d": 1}
    rows = [(k, i, float(v)) for k, m in n.items() for i, v in enumerate(np.round(RNG.gamma(0.6, 30, m), 1))]
    pdf = pd.DataFrame(rows, columns=["k", "pos", "v"])
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


def test_running_and_row_numbers(skewed):
    df, pdf = skewed
    got = running(df, ["k"], ["v", "pos"], {"s": ("sum", F.col("pos")), "m": ("max", F.col("pos")), "lo": ("min", F.col("pos"))},
                  totals=True, hot_rows=30).toPandas().sort_values(["k", "v", "pos"]).reset_index(drop=True)
    g = pdf.sort_values(["k", "v", "pos"]).groupby("k")["pos"]
    assert (got["s"].to_numpy() == g.cumsum().to_numpy()).all()
    assert (got["m"].to_numpy() == g.cummax().to_numpy()).all()
    assert (got["lo"].to_numpy() == g.cummin().to_numpy()).all()
    assert (got["tot_s"] == got["k"].map(pdf.groupby("k")["pos"].sum())).all()
    rn = row_numbers(df, ["k"], ["v", "pos"], n="n", hot_rows=30).toPandas().sort_values(["k", "v", "pos"])
    assert (rn["rn"].to_numpy() == rn.groupby("k").cumcount().to_numpy() + 1).all()
    assert (rn["n"] == rn["k"].map(pdf["k"].value_counts())).all()


@pytest.mark.parametrize("hot", [30, None])
def test_quantiles(skewed, hot):
    df, pdf = skewed
    got = quantiles(df, ["k"], "v", {"q10": 0.1, "q95": 0.95, "lo": 0.0, "hi": 1.0}, hot).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "q10"] == pytest.approx(np.quantile(g["v"], 0.1))
        assert got.loc[k, "q95"] == pytest.approx(np.quantile(g["v"], 0.95))
        assert (got.loc[k, "lo"], got.loc[k, "hi"]) == (g["v"].min(), g["v"].max())


def test_global_quantile_without_keys(skewed):
    df, pdf = skewed
    assert quantiles(df, [], "v", {"q": 0.37}, 30).collect()[0]["q"] == pytest.approx(np.quantile(pdf["v"], 0.37))


def test_order_statistic_and_ranks(skewed):
    df, pdf = skewed
    got = order_statistic(df, ["k"], "v", F.lit(5), "x", 30).toPandas().set_index("k")["x"]
    assert got["a"] == np.sort(pdf[pdf.k == "a"]["v"])[4] and got["d"] == float("inf")
    r = average_ranks(df, ["k"], "v", {}, 30).toPandas()
    a = r[r.k == "a"].set_index("v")["avg_rank"]
    want = pdf[pdf.k == "a"]["v"].rank()
    assert all(a[v] == pytest.approx(w) for v, w in zip(pdf[pdf.k == "a"]["v"], want))


def test_chunked_lags_and_rolling(skewed):
    df, pdf = skewed
    got = features.lags(df, ["k"], "pos", "v", 9, chunk_rows=16).toPandas().sort_values(["k", "pos"])
    g = pdf.sort_values(["k", "pos"]).groupby("k")["v"]
    assert len(got) == len(pdf)
    for i in (1, 9):
        np.testing.assert_array_equal(got[f"v_lag{i}"].to_numpy(), g.shift(i).to_numpy())
    roll = features.rolling(df, ["k"], "pos", "v", 12, "avg", "r", include_current=False, chunk_rows=13).toPandas().sort_values(["k", "pos"])
    want = g.apply(lambda s: s.shift(1).rolling(12).mean()).to_numpy()
    np.testing.assert_allclose(roll["r"].to_numpy(), want)
    w = features.windows(df, ["k"], "pos", ["v"], "v", 5, 3, chunk_rows=8)
    assert w.count() == sum(max(0, m - 7) for m in pdf["k"].value_counts())


def test_linear_scan_matches_loop(spark):
    p = RNG.gamma(0.5, 10, 2000)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(2000), "p": p}))
    for decay in (0.92, 0.4, 0.98):
        got = series.linear_scan(df, ["k"], "pos", "p", F.lit(decay), decay, decay, chunk_rows=4).toPandas().sort_values("pos")["state"]
        s, want = 0.0, []
        for v in p:
            s = decay * s + v
            want.append(s)
        np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-9)


def test_hash_split_counts(skewed):
    df, pdf = skewed
    got = splits.hash_split(df.withColumn("id", F.concat_ws("-", "k", "pos")), ["k"], "id", {"train": 0.7, "val": 0.1, "test": 0.2}, 3).toPandas()
    n = pdf["k"].value_counts()
    assert (got[got.role == "train"]["k"].value_counts().get("a")) == int(n["a"] * 0.7)
    assert len(got) == len(pdf)


def _mk(y, t):
    s = sum(np.sign(y[j] - y[i]) for i in range(len(y)) for j in range(i + 1, len(y)))
    slopes = [(y[j] - y[i]) / (t[j] - t[i]) for i in range(len(y)) for j in range(i + 1, len(y))]
    return s, np.median(slopes)


def test_trend_over_many_blocks(spark):
    y = {"a": np.round(np.cumsum(RNG.normal(0.2, 3, 150)), 1), "b": np.round(RNG.normal(0, 1, 20), 1), "c": np.array([1.0, 2.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(v)), "v": v}) for k, v in y.items()])
    df = spark.createDataFrame(pdf)
    for rows in (40, 2048):
        mk = trend.mann_kendall(df, ["k"], "t", "v", rows).toPandas().set_index("k")
        sen = trend.sen_slope(df, ["k"], "t", "v", rows).toPandas().set_index("k")["sen_slope"]
        for k, v in y.items():
            s, slope = _mk(v, np.arange(len(v)))
            assert mk.loc[k, "s"] == s
            assert sen[k] == pytest.approx(slope, abs=1e-9)


def test_spatial_over_many_blocks(spark):
    n, m = 130, 70
    st = pd.DataFrame({"id": np.arange(n), "x": RNG.uniform(0, 50, n), "y": RNG.uniform(0, 50, n), "value": RNG.normal(0, 5, n)})
    ce = pd.DataFrame({"cell_id": np.arange(m), "x": RNG.uniform(0, 50, m), "y": RNG.uniform(0, 50, m)})
    s, c = spark.createDataFrame(st), spark.createDataFrame(ce)
    d = np.hypot(ce.x.to_numpy()[:, None] - st.x.to_numpy(), ce.y.to_numpy()[:, None] - st.y.to_numpy())
    w = 1 / np.maximum(d, 1e-9) ** 2
    got = spatial.idw(s, c, [], "cell_id", block_rows=30).toPandas().sort_values("cell_id")["pred"]
    np.testing.assert_allclose(got, (w @ st.value.to_numpy()) / w.sum(1))
    near = spatial.nearest(s, c, [], "cell_id", 4, block_rows=30).toPandas().sort_values(["cell_id", "rank"])
    np.testing.assert_array_equal(near["id"].to_numpy().reshape(m, 4), np.argsort(d, axis=1, kind="stable")[:, :4])
    wi = np.where(d <= 9.0, w, 0)
    got = spatial.idw_within(s, c, [], "cell_id", 9.0, block_rows=5).toPandas().set_index("cell_id")["pred"]
    want = {i: (wi[i] @ st.value.to_numpy()) / wi[i].sum() for i in range(m) if wi[i].sum() > 0}
    assert set(got.index) == set(want) and all(got[i] == pytest.approx(v) for i, v in want.items())
    iu, ju = np.triu_indices(n, 1)
    pd_ = np.hypot(st.x.to_numpy()[iu] - st.x.to_numpy()[ju], st.y.to_numpy()[iu] - st.y.to_numpy()[ju])
    q = spatial.pair_distance_quantile(s, [], 0.9, block_rows=30).collect()[0]["max_dist"]
    assert q == pytest.approx(np.percentile(pd_, 90), rel=1e-9)
    v = spatial.variogram(s, [], n_bins=6, block_rows=30).toPandas().sort_values("bin")
    idx = np.digitize(pd_, np.linspace(0, q, 7)) - 1
    sq = 0.5 * (st.value.to_numpy()[iu] - st.value.to_numpy()[ju]) ** 2
    assert list(v["n_pairs"]) == [int((idx == b).sum()) for b in range(6)]
    np.testing.assert_allclose(v["gamma"], [sq[idx == b].mean() for b in range(6)])


def test_auc_threshold_and_conformal_with_ranges(spark):
    n = 600
    pdf = pd.DataFrame({"k": np.where(np.arange(n) < 400, "hot", "cold"), "y": RNG.integers(0, 2, n), "p": np.round(RNG.uniform(0, 1, n), 2)})
    df = spark.createDataFrame(pdf)
    a = metrics.binary_probability(df, ["k"], "y", "p", hot_rows=20).toPandas().set_index("k")["auc"]
    t = raster.best_threshold(df, ["k"], "p", "y", hot_rows=20).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        pos, neg = g[g.y == 1]["p"].to_numpy(), g[g.y == 0]["p"].to_numpy()
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert a[k] == pytest.approx(auc)
        u = np.unique(g["p"])
        best = (-1, None)
        for c in np.concatenate([[u[0] - 1e-3], (u[:-1] + u[1:]) / 2, [u[-1] + 1e-3]]):
            pr = (g["p"] >= c).astype(int)
            f = []
            for cls in np.union1d(g["y"], pr):
                tp, fp, fn = ((pr == cls) & (g.y == cls)).sum(), ((pr == cls) & (g.y != cls)).sum(), ((pr != cls) & (g.y == cls)).sum()
                f.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
            if np.mean(f) > best[0] + 1e-12:
                best = (np.mean(f), c)
        assert t.loc[k, "threshold"] == pytest.approx(best[1])
    q = intervals.conformal_quantile(df, ["k"], "p", 0.9, hot_rows=20).toPandas().set_index("k")["q"]
    for k, g in pdf.groupby("k"):
        assert q[k] == np.sort(g["p"])[int(np.ceil((len(g) + 1) * 0.9)) - 1]


def test_declustering_across_chunks(spark):
    v = np.where(RNG.uniform(0, 1, 300) < 0.3, RNG.uniform(10, 20, 300), 1.0)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(300), "v": v}))
    got = extremes.peaks_over_threshold(df, ["k"], "pos", "v", F.lit(5.0), 2, chunk_rows=16).count()
    at = np.flatnonzero(v > 5)
    assert got == 1 + int((np.diff(at) > 2).sum())


def test_pack_bounds_block_size(spark):
    df = spark.range(5000).withColumn("k", F.lit("a")).withColumn("x", F.col("id").cast("double"))
    sizes = [r[0] for r in blocks.pack(df, ["k"], ["x"], "id", 500).select(F.size("x")).collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) < 700


def test_pair_quantile_over_many_decades(spark):
    v = 10.0 ** RNG.uniform(-20, 20, 120) * RNG.choice([-1, 1], 120)
    pdf = pd.DataFrame({"k": [None] * 60 + ["b"] * 60, "t": list(range(60)) * 2, "v": v})
    df = spark.createDataFrame(pdf, "k string, t long, v double")
    one = {r["k"]: r["sen_slope"] for r in trend.sen_slope(df, ["k"], "t", "v", 2048).collect()}
    many = {r["k"]: r["sen_slope"] for r in trend.sen_slope(df, ["k"], "t", "v", 32).collect()}
    assert set(one) == {None, "b"} and one == many
    for k, part in ((None, v[:60]), ("b", v[60:])):
        assert one[k] == pytest.approx(_mk(part, np.arange(60))[1], rel=1e-12)


@pytest.mark.parametrize("cast", ["long", "date", "string", "timestamp", "double"])
def test_row_numbers_of_null_keys_and_any_order(spark, cast):
    base = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"),
                                  F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") * 37 % 61).alias("d"), "id")
    day = F.datediff("d", F.lit("1970-01-01"))
    o = F.when(F.col("id") > 3, {"long": day.cast("long"), "double": day.cast("double")}.get(cast, F.col("d").cast(cast)))
    df = base.select("k", "id", o.alias("o"))
    want = sorted(row_numbers(df, ["k"], ["o", "id"], n="n", hot_rows=None).collect(), key=str)
    got = sorted(row_numbers(df, ["k"], ["o", "id"], n="n", hot_rows=5).collect(), key=str)
    assert len(got) == 60 and [r.asDict() for r in got] == [r.asDict() for r in want]


def test_quantiles_of_null_keys(spark):
    df = spark.range(80).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    want = sorted(map(str, quantiles(df, ["k"], "v", {"q": 0.3}, None).collect()))
    assert len(want) == 2 and sorted(map(str, quantiles(df, ["k"], "v", {"q": 0.3}, 5).collect())) == want
