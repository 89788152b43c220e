"""Hand-computed values, directions and leakage properties."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks import contracts
from gaugeworks.functions import stats
from gaugeworks.operators import (extremes, features, forecast, gates, hier, hydro, intervals, ledger, metrics, models,
                                  score, spatial, splits, text, trend)
from gaugeworks.sources import io


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def preds(spark, t, p):
    return frame(spark, [("m", float(a), float(b)) for a, b in zip(t, p)], "method string, y_true double, y_pred double")


def one(df):
    return df.collect()[0]


def test_error_metrics(spark):
    m = one(metrics.table(preds(spark, [0, 0], [1, 1]), ["method"], ["rmse", "mae", "bias"]))
    assert (m["rmse"], m["mae"], m["bias"]) == (1.0, 1.0, 1.0)
    assert one(metrics.table(preds(spark, [0, 0], [2, 0]), ["method"], ["mae"]))["mae"] == 1.0
    y = [1, 2, 3, 4]
    assert one(metrics.table(preds(spark, y, y), ["method"], ["acc"]))["acc"] == pytest.approx(1.0)
    assert one(metrics.table(preds(spark, y, [5 - v for v in y]), ["method"], ["acc"]))["acc"] == pytest.approx(-1.0)
    assert one(metrics.table(preds(spark, [3, 3], [1, 2]), ["method"], ["nse"]))["nse"] is None


def test_polar_error_weighs_less(spark):
    rows = [(g, lat, 0.0, 10.0 if lat == (80.0 if g == "pole" else 0.0) else 0.0) for g in ("pole", "equator") for lat in (0.0, 80.0)]
    d = frame(spark, rows, "g string, lat double, y_true double, y_pred double")
    r = {x["g"]: x["lat_rmse"] for x in metrics.latitude_rmse(d, ["g"], "lat").collect()}
    assert r["pole"] < r["equator"]


def test_skill_and_classes(spark):
    m = frame(spark, [("a", 0.5), ("ref", 1.0)], "method string, rmse double")
    s = {r["method"]: r["skill"] for r in score.skill_against(m, [], "ref").collect()}
    assert s["a"] == pytest.approx(0.5)
    c = frame(spark, [(0, 0), (1, 1), (1, 0), (0, 0)], "t int, p int")
    assert one(metrics.classification(c, [], "t", "p"))["accuracy"] == 0.75


def test_conjugate_posterior(spark):
    d = frame(spark, [(1, v) for v in (1.0, 1.2, 0.8)], "station int, value double")
    s = hier.sufficient_stats(d, ["station"], "value").withColumns({"mu": F.lit(0.0), "tau": F.lit(2.0), "sigma": F.lit(1.0)})
    r = one(hier.shrink(s))
    assert r["post_mean"] == pytest.approx(3.0 / 3.25) and r["post_sd"] == pytest.approx(np.sqrt(1 / 3.25))
    single = one(hier.sufficient_stats(frame(spark, [(1, 5.0)], "station int, value double"), ["station"], "value"))
    assert single["svar"] == 0.0


def test_conformal_ranks_and_normal_quantiles(spark):
    nine = frame(spark, [(float(i),) for i in range(1, 10)], "s double")
    assert one(intervals.conformal_quantile(nine, [], "s", 0.9))["q"] == 9.0
    assert one(intervals.conformal_quantile(nine.limit(2), [], "s", 0.95))["q"] == float("inf")
    for lv, z in ((0.95, 1.959964), (0.90, 1.644854), (0.80, 1.281552)):
        assert stats.normal_z(lv) == pytest.approx(z, abs=1e-6)
        got = one(spark.range(1).select(stats.norm_ppf(F.lit(0.5 + lv / 2)).alias("z")))["z"]
        assert got == pytest.approx(z, abs=1e-6)
    g = one(spark.range(1).select(stats.gamma(F.lit(4.0)).alias("a"), stats.norm_cdf(F.lit(1.96)).alias("b")))
    assert g["a"] == pytest.approx(6.0) and g["b"] == pytest.approx(0.9750021, abs=1e-6)


def test_normalized_widths_grow_with_sigma(spark):
    cal = frame(spark, [(float(i), 0.0, 1.0) for i in range(30)], "y_true double, y_pred double, sigma double")
    test = frame(spark, [(0.0, 0.0, s) for s in (0.5, 1.0, 2.0, 4.0)], "y_true double, y_pred double, sigma double")
    b = intervals.normalized_conformal(cal, test, [], [0.8], "sigma").orderBy("sigma").collect()
    w = [r["upper"] - r["lower"] for r in b]
    assert all(x < y for x, y in zip(w, w[1:]))


def test_idw_returns_station_value(spark):
    s = frame(spark, [(1, 0.0, 0.0, 5.0), (2, 3.0, 4.0, 9.0)], "id long, x double, y double, value double")
    c = s.select(F.col("id").alias("cell_id"), "x", "y")
    r = {x["cell_id"]: x["pred"] for x in spatial.idw(s, c, [], "cell_id").collect()}
    assert r[1] == pytest.approx(5.0, abs=1e-6) and r[2] == pytest.approx(9.0, abs=1e-6)
    k = {x["cell_id"]: x["mean"] for x in spatial.kriging(s, c, [], "cell_id", nugget=1e-9, sill=1.0, rng=2.0).collect()}
    assert k[1] == pytest.approx(5.0, abs=1e-4)


def test_trend_directions(spark):
    rng = np.random.default_rng(1)
    t = np.arange(40)
    y = {"up": 2 * t + rng.normal(0, 1, 40), "down": -1.5 * t + rng.normal(0, 1, 40), "flat": rng.normal(0, 1, 40)}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "t": t, "v": v}) for k, v in y.items()]))
    mk = trend.mann_kendall(d, ["k"], "t", "v").toPandas().set_index("k")
    sl = trend.sen_slope(d, ["k"], "t", "v").toPandas().set_index("k")["sen_slope"]
    assert mk.loc["up", "z"] > 0 and mk.loc["up", "p_value"] < 0.05 and sl["up"] == pytest.approx(2, abs=0.1)
    assert mk.loc["down", "z"] < 0 and mk.loc["down", "p_value"] < 0.05 and sl["down"] < 0
    assert mk.loc["flat", "p_value"] > 0.05


def test_return_levels_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    x = 30 - 6 * np.log(-np.log(rng.uniform(size=60)))
    bm = spark.createDataFrame(pd.DataFrame({"k": "a", "year": np.arange(60), "value": x}))
    ci = extremes.bootstrap_ci(bm, ["k"], "value", [20, 50, 100], n_boot=60).orderBy("period").collect()
    lv = [r["level"] for r in ci]
    assert lv[0] < lv[1] < lv[2]
    assert all(r["lo"] <= r["level"] <= r["hi"] for r in ci)
    assert ci[2]["hi"] - ci[2]["lo"] >= ci[0]["hi"] - ci[0]["lo"]
    lm = one(extremes.gev_nll(bm, extremes.gev_fit(bm, ["k"], "value"), ["k"], "value"))["nll"]
    ml = one(extremes.gev_mle(bm, ["k"], "value"))
    assert ml["nll"] <= lm + 1e-6 and ml["scale"] > 0
    assert extremes.gev_fit(bm.filter("year < 2"), ["k"], "value").count() == 0


def test_composite_and_fingerprint(spark):
    d = frame(spark, [(9.0, 10.0, [10.0, 11.0, 20.0])], "v double, t double, f array<double>")
    c = one(d.select(ledger.composite(F.col("v"), F.col("t"), F.col("f"), higher_is_better=False, penalty=0.5, threshold=-12.0).alias("c")))["c"]
    assert c == -10.5
    assert ledger.fingerprint("rmse", False, 0.5, -12.0) == "942df6a8450d8d57"
    led = frame(spark, [(1, "942df6a8450d8d57"), (2, "other")], "experiment_num int, composite_fingerprint string")
    ledger.assert_fingerprint("942df6a8450d8d57", led)
    ledger.assert_fingerprint("anything", None)
    with pytest.raises(ledger.FingerprintError):
        ledger.assert_fingerprint("changed", led)


def test_champion_keeps_incumbent_on_ties(spark):
    d = frame(spark, [("p", i, c) for i, c in enumerate([-2.0, -1.9, -1.9, -2.5, -1.0])], "k string, experiment_num int, composite double")
    s = [r["status"] for r in ledger.champions(d, ["k"]).orderBy("experiment_num").collect()]
    assert s == ["KEEP", "KEEP", "DISCARD", "DISCARD", "KEEP"]


@pytest.mark.parametrize("n,cuts", [(5760, (4031, 865, 864)), (7300, (5110, 1095, 1095))])
def test_time_split_truncates(spark, n, cuts):
    d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    r = {x["role"]: x["count"] for x in splits.time_split(d, ["k"], "pos").groupBy("role").count().collect()}
    assert (r["train"], r["val"], r["test"]) == cuts


def test_folds_are_disjoint_and_ordered(spark):
    d = spark.range(700).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    f = splits.walk_forward(d, ["k"], "pos", 7, 3, gap=1)
    splits.assert_disjoint(f, ["k", "pos"])
    b = f.groupBy("fold_id", "role").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).toPandas().set_index(["fold_id", "role"])
    for k in range(4):
        assert b.loc[(k, "train"), "hi"] < b.loc[(k, "val"), "lo"] and b.loc[(k, "val"), "hi"] + 1 < b.loc[(k, "test"), "lo"]
    with pytest.raises(AssertionError):
        splits.assert_disjoint(f.unionByName(f.withColumn("role", F.lit("test"))), ["k", "pos"])
    s = splits.super_fold(d.withColumn("regime", F.col("pos") % 3), ["k"], "regime", "pos", buffer=2)
    assert s.filter("role = 'test'").select("regime").distinct().count() == 3
    with pytest.raises(ValueError):
        splits.create("nope")


def test_lags_see_only_the_past(spark):
    d = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    r = features.complete_cases(features.lags(d, ["k"], "pos", "v", 7), [f"v_lag{i}" for i in range(1, 8)]).orderBy("pos").collect()
    assert len(r) == 13 and r[0]["v"] == 7.0
    assert all(x[f"v_lag{i}"] == x["v"] - i for x in r for i in range(1, 8))


def test_ar_recovers_linear_recursion(spark):
    v = [1.0, 2.0]
    for _ in range(198):
        v.append(0.6 * v[-1] + 0.3 * v[-2] + 1.0)
    v = np.array(v) + np.random.default_rng(0).normal(0, 1e-3, 200)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(200), "v": v, "role": ["train"] * 150 + ["test"] * 50}))
    p = forecast.ar_one_step(d, ["k"], "pos", "pos", "v", 2)
    assert one(metrics.table(p, ["method"], ["rmse"]))["rmse"] < 0.01
    h3 = forecast.ar_rolling(d, ["k"], "pos", "pos", "v", 3, 2)
    assert h3.count() == 50 and one(metrics.table(h3, ["method"], ["rmse"]))["rmse"] < 0.02


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2))
    y = 1.5 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 50)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "x1": x[:, 0], "x2": x[:, 1], "y": y}))
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    got = one(models.ridge(d, ["k"], ["x1", "x2"], "y", 1.0, penalise_intercept=False))["beta"]
    np.testing.assert_allclose(got, [y.mean() - x.mean(0) @ b, *b])
    a = np.column_stack([np.ones(50), x])
    np.testing.assert_allclose(one(models.ols_gram(d, ["k"], ["x1", "x2"], "y"))["beta"], np.linalg.solve(a.T @ a + 1e-6 * np.eye(3), a.T @ y))


def test_routing_kernel():
    k = hydro.triangular_kernel(5, 2)
    assert sum(k) == pytest.approx(1.0) and max(k) == k[2] and len(k) == 5


COMMENTS = [
    (1, "At night the agave is visited by the long-nosed bat."),
    (2, "monarch butterfly caterpillars were feeding on the milkweed leaves."),
    (3, "A jaguar browsed near the river, the white-tailed deer fled from monarchs."),
    (4, "The hummingbird pollinates the agave and the agave depends on the hummingbird."),
    (5, "The riverbat pollinates agave."),
    (6, None),
]


def test_text_extraction(spark):
    d = frame(spark, COMMENTS, "id long, text string")
    kw = {(r[0], r[1], r[2], r[3]) for r in text.extract_all(d, "id", "text", "keyword").collect()}
    cue = {(r[0], r[1], r[2], r[3]) for r in text.extract_all(d, "id", "text", "cue").collect()}
    assert not any(r[0] == 1 for r in kw)
    assert (2, "monarch butterfly", "feeds_on", "milkweed") in kw
    assert (4, "hummingbird", "pollinates", "agave") in kw and (4, "agave", "depends_on", "hummingbird") in kw
    assert (1, "long-nosed bat", "pollinates", "agave") in cue
    assert (2, "monarch butterfly", "depends_on", "milkweed") in cue
    assert (3, "jaguar", "feeds_on", "white-tailed deer") in cue
    assert not any(r[0] == 5 for r in cue)   # letters touch the alias
    spans = {r["id"]: [(s["pos"], s["term"]) for s in r["spans"]] for r in text.tag_terms(d.filter("text is not null"), "text").collect()}
    assert spans[1] == [(13, "agave"), (37, "long-nosed bat")]
    al = {r["id"]: [s["term"] for s in r["spans"]] for r in text.tag_terms(d.filter("id = 3"), "text", aliases=True).collect()}
    assert al[3] == ["jaguar", "white-tailed deer", "monarch butterfly"]
    gold = frame(spark, [(1, "long-nosed bat", "pollinates", "agave"), (9, "jaguar", "feeds_on", "agave")], "id long, subject string, relation string, object string")
    s = one(text.score_triples(gold, text.extract_all(d, "id", "text", "cue"), "id"))
    assert s["tp"] == 1 and s["fn"] == 1 and s["invalid_triples"] == 0
    nodes, edges = text.interaction_graph(gold)
    assert nodes.count() == 3 and edges.count() == 2


def test_sequential_marking_where_names_cross(spark):
    voc = text.Vocabulary(terms=("red oak", "oak moth larva"), relations=("feeds_on",), aliases={}, verbs={"feeds_on": ["eats"]},
                          cues=((r"\beats\b", "feeds_on", "SO"),))
    assert text._bounded_pattern(voc) is None
    d = frame(spark, [(1, "red oak moth larva eats red oak")], "id long, text string")
    assert [tuple(r)[1:] for r in text.extract_all(d, "id", "text", "cue", voc).collect()] == [("oak moth larva", "feeds_on", "red oak")]


GOOD = ("Smith et al. (2024), 'Verification of daily forecasts', Journal of Climate, arXiv: 2401.12345 — motivates the use of a "
        "latitude weighted error as the headline score because " + "polar cells are small and would otherwise dominate the mean " * 3)


def test_gates(spark):
    d = frame(spark, [(1, GOOD), (2, "(Model2025)"), (3, "  "), (4, "TODO-REWRITE")], "id long, citations string")
    v = {r["id"]: list(r["violations"]) for r in gates.check_citations(d, "citations").collect()}
    assert v[1] == [] and v[3] == ["empty"] and "bare_tag" in v[2] and "placeholder" in v[4]
    long = "the mechanism is persistence because of storage " * 12
    a = frame(spark, [(1, long, GOOD, long, long + " skill +0.05 to +0.12", "KEEP " + long, "axis open " + long), (2, "short", GOOD, "short", "better", "", "")],
              "experiment_num int, diagnosis string, citations string, hypothesis string, prediction string, verdict string, learning string")
    r = {x["experiment_num"]: x for x in gates.check_annotations(a, True).collect()}
    assert r[1]["passed"], r[1]["violations"]
    assert {"diagnosis_too_short", "hypothesis_keyword", "prediction_range", "verdict_keyword"} <= set(r[2]["violations"])
    words = frame(spark, [(" a  b\tc\n",), ("",), (None,)], "t string").select(text.word_count(F.col("t")).alias("n")).collect()
    assert [w["n"] for w in words] == [3, 0, 0]


def test_annotation_merge(spark):
    pre = frame(spark, [(1, "d", "c", "h", "p")], "experiment_num int, diagnosis string, citations string, hypothesis string, prediction string")
    post = frame(spark, [(1, "KEEP", "x"), (2, "DISCARD", "y")], "experiment_num int, verdict string, learning string")
    r = {x["experiment_num"]: x for x in ledger.merge_annotations(pre, post).collect()}
    assert r[1]["diagnosis"] == "d" and r[1]["verdict"] == "KEEP" and not r[1]["needs_rewrite"]
    assert r[2]["diagnosis"].startswith("TODO-REWRITE") and r[2]["needs_rewrite"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"r1": {"event": "flood", "location": "x"}, "r2": {"event": "drought", "location": "y"}}))
    m = io.scan_json_map(spark, str(tmp_path / "a.json"), "struct<event:string,location:string>").collect()
    assert {(r["id"], r["event"]) for r in m} == {("r1", "flood"), ("r2", "drought")}
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"v": 1}, {"v": 2}], "meta": {}}))
    assert io.scan_results(spark, str(tmp_path / "p.json"), "struct<v:int>").count() == 2
    (tmp_path / "w.txt").write_text("# head\n 1   2.5\n2\t\tx\n\n")
    w = io.scan_whitespace(spark, str(tmp_path / "w.txt"), {"id": "int", "v": "double"}).orderBy("id").collect()
    assert [tuple(r) for r in w] == [(1, 2.5), (2, None)]
    led = tmp_path / "ledger"
    rows = frame(spark, [(1, "b", 1.0, 1.0, [1.0], -1.0, "f", "KEEP")], ledger.LEDGER_SCHEMA)
    ledger.append(rows, str(led))
    ledger.append(rows.withColumn("experiment_num", F.lit(2)), str(led))
    (led / "bad.json").write_text('{"experiment_num": 3, broken\n')
    got = ledger.scan(spark, str(led))
    assert sorted(r["experiment_num"] for r in got.collect()) == [1, 2] and ledger.next_number(got) == 3
    p = one(io.provenance(spark, str(tmp_path / "w.txt"), "s", {"q": "1"}))
    assert len(p["sha256"]) == 64 and p["bytes"] == 22
    long_rows = frame(spark, [("e", "m", "rmse", 1.0)], "experiment string, method string, metric string, value double")
    io.write_metrics(long_rows, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 1


def test_contracts(spark):
    d = frame(spark, [("a", 1.0)], "series_id string, value double")
    with pytest.raises(contracts.ContractError, match="date: missing"):
        contracts.assert_contract(d, "daily_series")
    with pytest.raises(contracts.ContractError, match="is not"):
        contracts.assert_contract(d, "series_id string, value float")
    assert contracts.assert_contract(d, "value double").columns == ["value"]


def test_no_key_and_empty_inputs(spark):
    e = frame(spark, [], "y_true double, y_pred double, k string, pos long")
    assert intervals.conformal_quantile(e, ["k"], "y_true", 0.9).count() == 0
    assert metrics.table(e, ["k"], ["rmse"]).count() == 0
    assert features.lags(e, ["k"], "pos", "y_true", 2).count() == 0
