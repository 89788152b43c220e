"""Ordered pairs and slopes without forming them, against the definition over all pairs; keys cut into many ranges, with nulls, ties and heavy tails."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import inversions, trend

RNG = np.random.default_rng(11)


def _slopes(t, y):
    i, j = np.triu_indices(len(t), 1)
    ok = t[i] != t[j]
    return np.sort((y[j] - y[i])[ok] / (t[j] - t[i])[ok])


def _up_down(t, v, w):
    later = t[:, None] < t[None, :]
    ww = w[:, None] * w[None, :]
    return int((ww * (later & (v[:, None] < v[None, :]))).sum()), int((ww * (later & (v[:, None] > v[None, :]))).sum())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 90])
def test_counts_and_lists(n):
    for _ in range(10):
        t, v, w = RNG.integers(0, max(1, n // 2), n).astype(float), RNG.integers(0, max(1, n // 3), n).astype(float), RNG.integers(1, 4, n)
        assert inversions.up_and_down(t, [v], w) == _up_down(t, v, w)
        i, j = inversions.inverted_pairs(inversions.dense_rank(v))
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(n) for b in range(a + 1, n) if v[a] > v[b]]


SERIES = {
    "walk": (np.arange(900.0), np.cumsum(RNG.normal(size=900))), "heavy": (np.arange(900.0), RNG.standard_cauchy(900) ** 3),
    "tied": (np.arange(900.0), np.round(RNG.gamma(0.3, 3, 900), 1)), "flat": (np.arange(700.0), np.zeros(700)),
    "mostly zero": (np.arange(900.0), np.where(RNG.random(900) < 0.8, 0, RNG.normal(size=900))), "same steps": (RNG.integers(0, 200, 900).astype(float), RNG.integers(0, 9, 900) / 7),
    "line": (np.arange(800.0), np.arange(800) / 3), "large": (np.arange(800.0), 1e15 + np.round(RNG.normal(size=800) * 100)),
}


@pytest.mark.parametrize("name", SERIES)
def test_selected_slopes_equal_the_sorted_ones(name):
    t, y = SERIES[name]
    want, s = _slopes(t, y), inversions.Slopes(t, y)
    assert s.pairs == len(want)
    for k in (0, 1, len(want) // 3, len(want) // 2, len(want) // 2 + 1, len(want) - 1):
        assert s.at(k) == pytest.approx(want[k], rel=1e-15, abs=0)
    assert inversions.slope_quantile(t, y, 0.5) == pytest.approx(np.median(want), rel=1e-14)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(t), float(y)) for k, (t, y) in SERIES.items() if k != "large" for t, y in zip(t[:260], y[:260])]
    rows += [(None, float(i), float(i % 5)) for i in range(90)] + [("few", 0.0, 1.0), ("few", 2.0, 2.0), ("one", 1.0, 5.0), ("gone", 1.0, None), ("walk", None, 3.0)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "y"])
    return spark.createDataFrame(rows, "k string, t double, y double").repartition(6).cache(), pdf.dropna(subset=["t", "y"])


@pytest.mark.parametrize("rows", [37, 1000])
def test_concordance_over_ranges(table, rows):
    df, pdf = table
    got = {r["k"]: (r["up"], r["down"]) for r in inversions.concordance(df, ["k"], "t", ["y"], group_rows=rows).collect()}
    want = {None if pd.isna(k) else k: _up_down(g["t"].to_numpy(), g["y"].to_numpy(), np.ones(len(g), int)) for k, g in pdf.groupby("k", dropna=False)}
    assert got == want
    all_ = inversions.concordance(df.where("k = 'tied'"), [], "t", ["y"], group_rows=rows).collect()
    assert [tuple(r) for r in all_] == [want["tied"]]


def test_concordance_of_weighted_rows_and_several_values(spark):
    t, a, b, w = (RNG.integers(0, m, 150) for m in (40, 3, 5, 4))
    df = spark.createDataFrame(pd.DataFrame({"t": t, "a": a, "b": b, "w": w}))
    got = inversions.concordance(df, [], "t", ["a", "b"], F.col("w"), group_rows=20).first()
    assert tuple(got) == _up_down(t, a * 10 + b, w)


def test_mann_kendall_of_split_keys_equals_that_of_whole_ones(table):
    df, _ = table
    one, many = ({r["k"]: tuple(r) for r in trend.mann_kendall(df.where("t is not null"), ["k"], "t", "y", n).collect()} for n in (1000, 41))
    assert one == many
    pairs = {r["k"]: (r["n_pairs"], r["n_up"]) for r in trend.pair_counts(df, ["k"], "t", "y", 41).collect()}
    assert pairs["few"] == (1, 1) and pairs["one"] == (0, 0) and pairs["flat"] == (260 * 259 // 2, 0)


def test_slopes_settled_over_the_bits(spark, monkeypatch):
    """The path of keys larger than a task, on small ones."""
    monkeypatch.setattr(inversions, "TRIAL_BITS", 8)      # fewer passes
    data = {None: "tied", "h": "heavy", "flat": "flat"}
    rows = [(k, float(a), float(b)) for k, name in data.items() for a, b in zip(*(c[:24] for c in SERIES[name]))] + [("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, y double")
    got = {r["k"]: r["s"] for r in inversions._large(df, ["k"], 0.5, "s", 10_000).collect()}
    assert got.keys() == data.keys()
    for k in data:
        t, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        assert got[k] == pytest.approx(np.median(_slopes(t, y)), rel=1e-14, abs=1e-300), k
