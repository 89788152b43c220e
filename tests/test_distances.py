"""Distances of all pairs by leaves, against plain versions; work on pairs of blocks spread over tasks."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import blocks, distances, spatial

RNG = np.random.default_rng(31)


def _field():
    """Dense clusters, a lattice with many equal distances, one place for many rows, a far row."""
    dense = RNG.normal(size=(300, 2)) * 0.01 + RNG.uniform(-50, 50, (3, 2))[RNG.integers(0, 3, 300)]
    lattice = RNG.integers(0, 9, (150, 2)).astype(float)
    xy = np.concatenate([dense, lattice, np.zeros((40, 2)), [[900.0, -3.0]]])
    return pd.DataFrame({"id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "value": np.round(RNG.normal(1e4, 2, len(xy)), 2)})


@pytest.mark.parametrize("rows", [70, 2048])
def test_quantile_and_variogram_with_nulls(spark, rows):
    one = _field()
    two = one.head(330).assign(network="b")
    three = pd.DataFrame({"network": "c", "id": [1], "x": [1.0], "y": [1.0], "value": [1.0]})
    pdf = pd.concat([one.assign(network=None), two, three], ignore_index=True)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, x double, y double, value double, network string")
    lost = spark.createDataFrame([(9_001, None, 1.0, 3.0, "b"), (9_002, 2.0, float("nan"), 3.0, None)], df.schema)
    df = df.union(lost).withColumn("value", F.when(F.col("id") % 7 != 3, F.col("value")))
    q = {r["network"]: r["max_dist"] for r in spatial.pair_distance_quantile(df, ["network"], 0.37, block_rows=rows).collect()}
    got = spatial.variogram(df, ["network"], n_bins=6, max_dist=11.0, block_rows=rows).toPandas()
    assert set(q) == {None, "b"}
    for k, g in ((None, one), ("b", two)):
        i, j = np.triu_indices(len(g), 1)
        d = np.sqrt((g.x.to_numpy()[i] - g.x.to_numpy()[j]) ** 2 + (g.y.to_numpy()[i] - g.y.to_numpy()[j]) ** 2)
        assert q[k] == pytest.approx(np.quantile(d, 0.37), rel=1e-14)
        z = g.value.where(g.id % 7 != 3).to_numpy()
        half = 0.5 * (z[i] - z[j]) ** 2
        bins = np.where(np.isnan(half) | (d >= 11.0), 6, np.floor(d / (11.0 / 6)))
        mine = got[got.network.isna() if k is None else got.network == k].sort_values("bin")
        assert mine.n_pairs.tolist() == [int((bins == b).sum()) for b in range(6)]
        np.testing.assert_allclose(mine.gamma, [half[bins == b].mean() if (bins == b).any() else np.nan for b in range(6)], rtol=1e-9)


def test_most_pairs_of_leaves_count_as_a_whole():
    n = 2048
    a = distances.Leaves(RNG.normal(0, 1, n), RNG.normal(0, 1, n))
    b = distances.Leaves(RNG.normal(35, 1, n), RNG.normal(0, 1, n))
    lo, hi = distances.bounds(a, b)
    d = np.concatenate([d.reshape(len(d), -1) for _, _, d in distances.compared(a, b, *np.nonzero(lo >= 0), False)])
    assert d.shape[0] == lo.size and (d >= lo.ravel()[:, None]).all() and (d <= hi.ravel()[:, None]).all()
    assert (np.floor(lo / 10) == np.floor(hi / 10)).mean() > 0.9


def test_quantile_compares_few_pairs(spark, monkeypatch):
    rows = SimpleNamespace(i=0, j=1, a_x=RNG.normal(0, 1, 2048), a_y=RNG.normal(0, 1, 2048), b_x=RNG.normal(9, 2, 2048), b_y=RNG.normal(0, 1, 2048))
    d = np.sqrt((rows.a_x[:, None] - rows.b_x) ** 2 + (rows.a_y[:, None] - rows.b_y) ** 2).ravel()
    got = distances._enclose(rows)
    assert got["least"].sum() == got["most"].sum() == d.size
    k = int(0.9 * d.size)
    lo, hi = (int(got["bin"][np.searchsorted(got[c].cumsum(), k, "right")]) << distances.FIRST for c in ("least", "most"))
    hi += (1 << distances.FIRST) - 1
    exact = int(distances._image(np.partition(d, k))[k])
    assert lo <= exact <= hi
    looked, compared = [], distances.compared
    monkeypatch.setattr(distances, "compared", lambda a, b, i, j, same: looked.append(len(i)) or compared(a, b, i, j, same))
    rows.asked = [dict(lo=lo, hi=hi, shift=max(0, (hi - lo + 1).bit_length() - distances.STEP))]
    c = distances._counts(rows)
    assert c["c"][c["bin"] == -1][0] == (distances._image(d) < lo).sum()
    at = c["bin"] >= 0
    assert c["c"][at].sum() == ((distances._image(d) >= lo) & (distances._image(d) <= hi)).sum()
    assert sum(looked) < 0.4 * 64 * 64


def test_edges_agree_with_the_rounded_division():
    for most in (33.7123, 1e-3 / 7, 11.0):
        edges = distances._edges(most, 15)
        before = np.nextafter(edges, 0)
        assert (distances._bin(np.sqrt(edges), most, 15) == np.arange(1, 16)).all() and (distances._bin(np.sqrt(before), most, 15) < np.arange(1, 16)).all()


def test_pairs_of_small_blocks_run_in_many_tasks(spark):
    packed = blocks.pack(spark.range(400).withColumn("x", F.col("id").cast("double")), [], ["x"], "id", 20)
    other = packed.select(*[F.col(c).alias(f"b_{c}") for c in packed.columns])
    left = packed.select(*[F.col(c).alias(f"a_{c}") for c in packed.columns])
    for pairs in (blocks.self_pairs(packed, []), blocks.cross_pairs(left, other, [])):
        assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def _copies(spark, n):
    """Some places, each with ``n`` stations of different values, and their cells."""
    xy = np.concatenate([RNG.normal(0, 20, (90, 2)).round(2), [[0.0, 0.0], [3.0, 4.0]]])
    at = np.repeat(np.arange(len(xy)), n)
    s = pd.DataFrame({"id": RNG.permutation(len(at)), "x": xy[at, 0], "y": xy[at, 1], "value": np.round(RNG.normal(1e4, 2, len(at)), 2)})
    c = pd.DataFrame({"cell_id": np.arange(30), "x": np.repeat([1.0, 0.0, 9.0], 10), "y": np.repeat([2.0, 0.0, -7.0], 10)})
    return s, c, spark.createDataFrame(s).repartition(4), spark.createDataFrame(c).repartition(4)


@pytest.mark.parametrize("rows", [25, 2048])
def test_copies_of_places_count_with_their_number(spark, rows):
    s, c, s_df, c_df = _copies(spark, 7)
    i, j = np.triu_indices(len(s), 1)
    d = np.sqrt((s.x.to_numpy()[i] - s.x.to_numpy()[j]) ** 2 + (s.y.to_numpy()[i] - s.y.to_numpy()[j]) ** 2)
    half = 0.5 * (s.value.to_numpy()[i] - s.value.to_numpy()[j]) ** 2
    for prob in (0.002, 0.5, 0.9):
        assert spatial.pair_distance_quantile(s_df, [], prob, block_rows=rows).first()[0] == pytest.approx(np.quantile(d, prob), rel=1e-14)
    got = spatial.variogram(s_df, [], n_bins=6, max_dist=31.0, block_rows=rows).toPandas().sort_values("bin")
    bins = np.where(d >= 31.0, 6, np.floor(d / (31.0 / 6)))
    assert got.n_pairs.tolist() == [int((bins == b).sum()) for b in range(6)]
    np.testing.assert_allclose(got.gamma, [half[bins == b].mean() for b in range(6)], rtol=1e-9)
    near = spatial.nearest(s_df, c_df, [], "cell_id", 9, block_rows=rows).toPandas()
    pred = spatial.idw(s_df, c_df, [], "cell_id", block_rows=rows).toPandas().set_index("cell_id").pred
    assert len(near) == 30 * 9 and len(pred) == 30
    for r in c.itertuples():
        far = np.sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2)
        assert near[near.cell_id == r.cell_id].sort_values("rank").id.tolist() == s.assign(d=far).sort_values(["d", "id"]).id.head(9).tolist()
        w = 1 / np.maximum(far, 1e-9) ** 2
        assert pred[r.cell_id] == pytest.approx((w * s.value).sum() / w.sum(), rel=1e-12)


def test_copies_of_places_do_not_multiply_the_work(spark):
    s, c, s_df, c_df = _copies(spark, 300)
    assert spatial._packed(s_df, [], "value", 64).selectExpr("sum(size(x))", "sum(aggregate(w, 0L, (a, v) -> a + v))").first()[:] == (92, 92 * 300)
    tall = c_df.crossJoin(spark.range(500).withColumnRenamed("id", "copy")).select((F.col("cell_id") * 500 + F.col("copy")).alias("cell_id"), "x", "y")
    seen = spark.sparkContext.accumulator(0)
    least = spatial._least

    def counted(v, k):
        seen.add(v.size)
        return least(v, k)

    spatial._least = counted
    try:
        assert spatial.nearest(s_df, tall, [], "cell_id", 16).count() == 30 * 500 * 16
    finally:
        spatial._least = least
    assert 0 < seen.value <= 3 * 92 * 16
