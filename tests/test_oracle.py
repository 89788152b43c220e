"""A cross-section of registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["c1_forecast_baselines", "w3_nowcast_frame", "w11_walk_forward_folds", "w14_linear_reservoir", "x3_r95p", "x12_trend_table",
         "x10_bootstrap_return_levels", "i3_normalized_conformal", "i8_empirical_bayes", "g21_semivariogram", "j13_bilinear_regrid",
         "j15_fill_nearest", "i11_best_threshold", "l1_term_spans", "l2_alias_spans", "l3_keyword_triples", "l4_cue_triples", "l8_citation_gate",
         "g18_probability_scores", "i20_hash_split", "w20_running_champion", "o1_benjamini_hochberg"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, msg = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "horizon", "method", "rmse", "mae", "acc", "skill"] and df.count() == 30
