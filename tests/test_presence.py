"""Covariates of the presence models: read from the texts once, and fits of folds side by side."""

import threading

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_covariates_are_stored_and_right(spark):
    from gaugeworks.plans import model_queries
    x = model_queries._presence(spark, SF)
    assert x.inputFiles() and not any("documents" in f for f in x.inputFiles())
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = x.collect()
    assert rows
    for r in rows:
        d = texts[r["doc_id"]]
        if d["text"] is None:
            assert r["p"] is None and r["e"] is None
        else:
            assert r["p"] == pytest.approx(d["text"].count("\n") / (d["n_chars"] + 1.0))
            assert r["e"] == pytest.approx(sum(c in "0123456789" for c in d["text"]) / (d["n_chars"] + 1.0))


def test_folds_fit_side_by_side(spark, monkeypatch):
    from gaugeworks.operators import models
    from pyspark.ml.classification import GBTClassifier
    meet, fit = threading.Barrier(3, timeout=60), GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: meet.wait() >= 0 and fit(self, df))
    df = spark.range(90).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    m = models.gbt_calibrated(df, ["a"], "y", "id", trees=2, depth=1)
    assert len(m.parts) == 3 and {r["prob"] for r in m.transform(df).collect()} == {0.0, 1.0}
