"""Tree, logistic and calibrated models (MLlib) and the pipelines around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features, metrics, models, raster, score
from ..operators.attach import attach
from ..session import store
from .base import cells, hourly_roled, patches, query, read, stations


def _covariates(spark, d):
    e = lambda i: F.round(F.element_at("embedding", i).cast("double") * 100.0, 4)
    x = read(spark, d, "embeddings").select("vec_id", e(1).alias("x"), e(2).alias("y"), e(3).alias("cov"), e(4).alias("value"), "label")
    return x.withColumns(scalars.spatial_design(F.col("x"), F.col("y"), F.col("cov"), 40.0))


_XS = ["fx", "fy", "fcov", "fxy", "fcov2", "fxcov", "fycov"]


def _surface(spark, d, fit):
    x = _covariates(spark, d)
    m = fit(x.filter("vec_id % 2 = 0"), _XS, "value")
    return m, models.assemble(x.filter("vec_id % 2 = 1"), _XS)


@query("i12_random_forest_regression")
def _(spark, d):
    m, test = _surface(spark, d, models.rf_regress)
    return m.transform(test).select("vec_id", F.col("value").alias("y_true"), "y_pred")


@query("i13_boosted_regression")
def _(spark, d):
    m, test = _surface(spark, d, models.gbt_regress)
    return m.transform(test).select("vec_id", F.col("value").alias("y_true"), "y_pred")


@query("t3k_top_features")
def _(spark, d):
    m, test = _surface(spark, d, models.rf_regress)
    imp = spark.createDataFrame(models.importances(m, _XS), "feature string, importance double")
    # the ranking is reported beside the number of cells the model was applied to
    n = m.transform(test).agg(F.count(F.lit(1)).alias("n_cells"))
    return score.top_features(attach(imp, n, []), 3)


@query("c7_covariate_interpolation")
def _(spark, d):
    out = None
    for name, fit in (("random_forest", models.rf_regress), ("boosted", models.gbt_regress)):
        m, test = _surface(spark, d, fit)
        p = m.transform(test).select(F.lit(name).alias("method"), F.col("value").alias("y_true"), "y_pred")
        out = p if out is None else out.unionByName(p)
    return metrics.table(out, ["method"], ["rmse", "mae", "bias"])


def _indices(spark, d):
    return raster.spectral_indices(patches(spark, d)).select("patch_id", F.col("label").cast("double").alias("label"), "ndvi", "ndwi", "swir_mean", "brightness")


_IX = ["ndvi", "ndwi", "swir_mean", "brightness"]


def _landcover(spark, d):
    x = _indices(spark, d)
    m = models.rf_classify(x.filter("patch_id % 4 <> 0"), _IX, "label")
    return m.transform(models.assemble(x.filter("patch_id % 4 = 0"), _IX)).select("patch_id", F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"))


@query("i14_random_forest_classes")
def _(spark, d):
    return _landcover(spark, d)


@query("c3_landcover_indices")
def _(spark, d):
    return metrics.classification(_landcover(spark, d), [], "label", "pred")


def _presence(spark, d):
    """Quality labels as presence, document length and word shape as covariates; stored, as the fits read them many times."""
    lab = read(spark, d, "labels").filter(F.col("quality").isNotNull())
    doc = read(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("t"), (_lost("text", F.replace("text", F.lit("\n"), F.lit(""))) / (F.col("n_chars") + 1.0)).alias("p"),
                                             (_lost("text", F.regexp_replace("text", "[0-9]", "")) / (F.col("n_chars") + 1.0)).alias("e"))
    x = lab.join(doc, "doc_id").select("doc_id", F.col("quality").alias("y_label"), "t", "p", "e")
    return store(x.withColumns({"t2": F.col("t") * F.col("t"), "p2": F.col("p") * F.col("p")}), "presence")


def _lost(text, left):
    """Characters that ``left`` lacks: counted by taking out the few, not the many."""
    return F.length(text) - F.length(left)


_GX = ["t", "p", "e", "t2", "p2"]


def _glm(spark, d, x=None):
    from pyspark.ml.functions import vector_to_array
    x = x or _presence(spark, d)
    m = models.glm_logistic(x.filter("doc_id % 10 < 7"), _GX, "y_label")
    return m.transform(models.assemble(x.filter("doc_id % 10 >= 7"), _GX, "_raw")).select(
        "doc_id", F.lit("glm").alias("method"), "y_label", vector_to_array("probability")[1].alias("prob"))


def _boosted(spark, d, x=None):
    x = x or _presence(spark, d)
    m = models.gbt_calibrated(x.filter("doc_id % 10 < 7"), ["t", "p", "e"], "y_label", "doc_id")
    return m, m.transform(x.filter("doc_id % 10 >= 7")).select("doc_id", F.lit("boosted").alias("method"), "y_label", "prob")


@query("i15_logistic_glm")
def _(spark, d):
    return _glm(spark, d)


@query("i16_calibrated_boosting")
def _(spark, d):
    return _boosted(spark, d)[1]


@query("i17_averaged_importances")
def _(spark, d):
    m, scored = _boosted(spark, d)
    n = scored.agg(F.count(F.lit(1)).alias("n_scored"))
    return attach(m.importances(spark), n, [])


@query("c10_species_distribution")
def _(spark, d):
    x = _presence(spark, d)
    both = _glm(spark, d, x).unionByName(_boosted(spark, d, x)[1])
    return metrics.binary_probability(both, ["method"], "y_label", "prob")


def _nowcast(spark, d, covariates):
    f, names = features.nowcast_frame(hourly_roled(spark, d).fillna({"pm25": 0.0, "wind": 0.0, "temp": 0.0, "boundary_layer": 0.0}),
                                      ["station"], "pos", "ts", "pm25", covariates)
    f = features.complete_cases(f, names)
    m = models.gbt_regress(f.filter("role <> 'test'"), names, "pm25")
    return m.transform(models.assemble(f.filter("role = 'test'"), names)).select(
        "station", "ts", F.col("pm25").alias("y_true"), F.greatest(F.col("y_pred"), F.lit(0.0)).alias("y_pred"))


_WEATHER = ["wind", "temp", "boundary_layer"]


@query("i19_weather_ablation")
def _(spark, d):
    p = score.ablate(lambda cov: _nowcast(spark, d, cov), {"weather": _WEATHER, "history": []})
    return metrics.table(p, ["method"], ["rmse", "mae"])


@query("c8_nowcast_comparison")
def _(spark, d):
    from ..operators import extremes, forecast
    h = hourly_roled(spark, d).fillna({"pm25": 0.0})
    gbt = _nowcast(spark, d, _WEATHER).withColumn("method", F.lit("boosted"))
    base = forecast.persistence(h, ["station"], "ts", "pos", "pm25", 1, clip=0.0).select("station", "ts", "y_true", "y_pred", "method")
    ar = forecast.ar_one_step(h, ["station"], "ts", "pos", "pm25", 6).select("station", "ts", "y_true", "y_pred", "method")
    p = score.align(gbt.unionByName(base).unionByName(ar), ["station"], "ts", 3)
    # an hourly record per station
    thr = extremes.threshold(h.filter("role <> 'test'"), ["station"], "pm25", 0.9, hot_rows=None)
    m = metrics.bundle(p.join(thr, "station"), ["method"], F.col("threshold"))
    return score.skill_against(m.select("method", "n", "rmse", "mae", "spike_f1"), [], "persistence")
