"""Metric tables: one aggregation pass per call, grouped by any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import skill as S
from .attach import attach
from .ordered import HOT_ROWS, average_ranks

def _tp() -> tuple[Column, Column]:
    return F.col("y_true"), F.col("y_pred")


def scored(df: DataFrame) -> DataFrame:
    """Rows on which both truth and prediction are present."""
    return df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def table(df: DataFrame, by, names) -> DataFrame:
    """One row per group with the named metrics (see ``functions.skill.REGISTRY``)."""
    return scored(df).groupBy(*by).agg(*[S.REGISTRY[n](*_tp()).alias(n) for n in names])


def bundle(df: DataFrame, by, threshold: Column | None = None) -> DataFrame:
    """All error, efficiency and (with a threshold) exceedance scores in one pass."""
    aggs = [S.REGISTRY[n](*_tp()).alias(n) for n in ("rmse", "mae", "bias", "nse", "kge", "acc")]
    if threshold is not None:
        aggs += [c.alias(f"spike_{n}") for n, c in S.spike(*_tp(), threshold).items()]
    return scored(df).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def anomaly_correlation(df: DataFrame, by, climatology: str) -> DataFrame:
    return scored(df).groupBy(*by).agg(S.acc_given(*_tp(), F.col(climatology)).alias("acc"))


def latitude_rmse(df: DataFrame, by, lat: str) -> DataFrame:
    """RMSE with cosine-latitude weights normalised over the distinct latitude rows.

    Cells are summed per latitude first, so the second step sees one row per
    latitude and group.
    """
    err = F.col("y_true") - F.col("y_pred")
    rows = scored(df).groupBy(*by, lat).agg(F.sum(err * err).alias("_se"), F.count(F.lit(1)).alias("_n"))
    c = F.cos(F.radians(lat))
    return rows.groupBy(*by).agg(
        F.sqrt(F.sum(F.col("_se") * c) / F.avg(c) / F.sum("_n")).alias("lat_rmse"))


def confusion_counts(df: DataFrame, by, true: str, pred: str) -> DataFrame:
    return df.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, by, true: str, pred: str) -> DataFrame:
    """Confusion matrix in long form, each true class normalised to its total."""
    c = confusion_counts(df, by, true, pred)
    row = W.partitionBy(*by, true)   # one row per predicted class
    return c.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(row), F.lit(1)))


def classification(df: DataFrame, by, true: str, pred: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the union of true and predicted classes."""
    c = confusion_counts(df, by, true, pred)
    hit = (F.col("cls") == F.col(true)) & (F.col("cls") == F.col(pred))
    per = (c.withColumn("cls", F.explode(F.array_distinct(F.array(true, pred))))
           .groupBy(*by, "cls").agg(
               F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
               F.sum(F.when(F.col("cls") == F.col(pred), F.col("n")).otherwise(0)).alias("np"),
               F.sum(F.when(F.col("cls") == F.col(true), F.col("n")).otherwise(0)).alias("nt")))
    prec = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    rec = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0)
    per = per.withColumn("prec", prec).withColumn("rec", rec)
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    return per.groupBy(*by).agg(
        (F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg("prec").alias("macro_precision"),
        F.avg("rec").alias("macro_recall"), F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def spike(df: DataFrame, by, threshold: Column) -> DataFrame:
    return scored(df).groupBy(*by).agg(*[c.alias(n) for n, c in S.spike(*_tp(), threshold).items()])


def binary_probability(df: DataFrame, by, label: str, prob: str, surface: str | None = None,
                       hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact AUC (average ranks for ties), Brier score and prevalence gap.

    Rows collapse to distinct scores before ranking; ``surface`` adds the
    correlation of the score with a reference surface.
    """
    d = df.filter(F.col(label).isNotNull() & F.col(prob).isNotNull())
    ranks = average_ranks(d, by, prob, {"_pos": F.col(label)}, hot_rows)
    auc = ranks.groupBy(*by).agg(
        F.sum(F.col("avg_rank") * F.col("_pos")).alias("_rs"), F.sum("_pos").alias("_np"), F.sum("n").alias("_nn"))
    np_, nn = F.col("_np"), F.col("_nn") - F.col("_np")
    auc = auc.select(*by, F.when((np_ > 0) & (nn > 0), (F.col("_rs") - np_ * (np_ + 1) / 2.0) / (np_ * nn)).alias("auc"))
    y, p = F.col(label).cast("double"), F.col(prob)
    aggs = [F.avg((p - y) * (p - y)).alias("brier"), F.abs(F.avg(p) - F.avg(y)).alias("prevalence_gap")]
    if surface:
        aggs.append(F.corr(p, F.col(surface)).alias("surface_corr"))
    rest = d.groupBy(*by).agg(*aggs)
    return attach(auc, rest, by)


def informativeness(df: DataFrame, by, covariate: str, value: str) -> DataFrame:
    """Pearson r of one covariate with the target and the R squared of a straight line."""
    return df.groupBy(*by).agg(F.corr(covariate, value).alias("pearson_r"),
                               F.regr_r2(value, covariate).alias("r2_linear"))
