"""The fitted residual scale against a plain fit, its floor, and the skill metric of the ledger loop."""

import numpy as np
import pandas as pd
import pytest

from gaugeworks.functions import skill
from gaugeworks.operators import intervals


def _ridge(x, y, lam):
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + lam * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ b, b


def test_scale_follows_the_residuals_and_keeps_its_floor(spark):
    r = np.random.default_rng(8)
    parts = []
    for k, grow in (("wide", 3.0), (None, 0.0)):
        x = r.uniform(0, 10, (80, 2))
        parts.append(pd.DataFrame({"k": k, "i": range(80), "a": x[:, 0], "b": x[:, 1], "y": 2 * x[:, 0] - x[:, 1] + r.normal(size=80) * (0.5 + grow * x[:, 0])}))
    pdf = pd.concat(parts, ignore_index=True)
    far = pd.DataFrame({"k": ["wide"], "i": [999], "a": [-500.0], "b": [0.0], "y": [0.0]})      # the linear scale is negative there
    rows = pd.concat([pdf, far])
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "k string, i long, a double, b double, y double")
    got = intervals.ridge_with_scale(df.where("i < 60"), df, ["k"], ["a", "b"], "y", 1.0).toPandas()
    assert len(got) == len(rows)
    for k in ("wide", None):
        mine = got[got.k.isna()] if k is None else got[got.k == k]
        t = mine[mine.i < 60]
        c0, c = _ridge(t[["a", "b"]].to_numpy(), t.y.to_numpy(), 1.0)
        pred = c0 + mine[["a", "b"]].to_numpy() @ c
        left = np.abs(t.y - (c0 + t[["a", "b"]].to_numpy() @ c)).to_numpy()
        s0, s = _ridge(t[["a", "b"]].to_numpy(), left, 1.0)
        np.testing.assert_allclose(mine.y_pred, pred, rtol=1e-9)
        np.testing.assert_allclose(mine.sigma, np.maximum(s0 + mine[["a", "b"]].to_numpy() @ s, 0.1 * left.mean()), rtol=1e-9)
    assert got[got.i == 999].sigma.iloc[0] < got[(got.k == "wide") & (got.a > 8)].sigma.min()


def test_skill_against_persistence(spark):
    df = spark.createDataFrame([(1.0, 1.5, 3.0), (2.0, 2.0, 1.0), (4.0, 3.0, 4.0)], "y_true double, y_pred double, reference_pred double")
    got = df.agg(skill.primary("skill_vs_persistence")).first()[0]
    assert got == pytest.approx(1 - np.sqrt((0.25 + 1) / 3) / np.sqrt(5 / 3))
    with pytest.raises(ValueError):
        skill.primary("best")
