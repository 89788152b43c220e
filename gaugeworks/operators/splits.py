"""Leakage-safe splits as role columns; nothing is sliced or copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import md5_int, regime_bins  # noqa: F401  (re-exported)
from .ordered import HOT_ROWS, row_numbers


def with_size(df: DataFrame, keys, out: str = "n") -> DataFrame:
    """Row count per key from a partial aggregate (small side of the join)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(n, list(keys))


def _sized(df: DataFrame, keys, n: str | None) -> DataFrame:
    return df.withColumn("_n", F.col(n).cast("long")) if n else with_size(df, keys, "_n")


def time_split(df: DataFrame, keys, pos: str, train: float = 0.7, val: float = 0.15, n: str | None = None) -> DataFrame:
    """Role train/val/test by position; cuts are truncated double products.

    ``n`` names a column with the key's row count (a dense series has it for free).
    """
    d = _sized(df, keys, n)
    a = F.floor(F.col("_n") * F.lit(float(train)))
    b = F.floor(F.col("_n") * F.lit(float(train + val)))
    role = F.when(F.col(pos) < a, "train").when(F.col(pos) < b, "val").otherwise("test")
    return d.withColumn("role", role).drop("_n")


def walk_forward(df: DataFrame, keys, pos: str, n_blocks: int = 5, n_initial: int = 2, expanding: bool = True,
                 val_fraction: float = 0.15, gap: int = 1, n: str | None = None) -> DataFrame:
    """Long fold table: each row once per fold it takes part in, with its role.

    The fold bounds are expressions of the key's row count, so no bounds table
    is joined; rows between the end of validation and the test block are
    ``purged``, and a fold without train or test rows is left out.
    """
    if n_initial < 1 or n_blocks <= n_initial:
        raise ValueError("need n_initial >= 1 and n_blocks > n_initial")
    d = _sized(df, keys, n)
    edge = lambda b: F.bround(F.col("_n") / F.lit(float(n_blocks)) * b, 0).cast("long")
    test_block = F.col("fold_id") + n_initial
    d = d.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - n_initial - 1))))
    lo = F.lit(0).cast("long") if expanding else edge(F.col("fold_id"))
    t0, t1 = edge(test_block), edge(test_block + 1)
    tv_end = t0 - gap
    n_val = F.greatest(F.lit(1).cast("long"), F.bround((tv_end - lo) * F.lit(float(val_fraction)), 0).cast("long"))
    p = F.col(pos)
    role = (F.when((p >= lo) & (p < tv_end - n_val), "train")
            .when((p >= tv_end - n_val) & (p < tv_end) & (p >= lo), "val")
            .when((p >= tv_end) & (p < t0) & (p >= lo), "purged")
            .when((p >= t0) & (p < t1), "test"))
    usable = (tv_end > lo) & (tv_end - lo - n_val > 0) & (t1 > t0)
    return (d.filter(usable).withColumn("role", role).filter(F.col("role").isNotNull())
            .withColumn("regime_label", F.concat(F.lit("walk-forward-block-"), test_block.cast("string"))).drop("_n"))


def super_fold(df: DataFrame, keys, regime: str, pos: str, val_fraction: float = 0.15, test_fraction: float = 0.15,
               buffer: int = 0, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One fold: the last share of every regime is test, the share before it validation,
    and ``buffer`` rows before that are purged."""
    d = row_numbers(df, list(keys) + [regime], [pos], out="_rn", n="_nr", hot_rows=hot_rows)
    nr, one = F.col("_nr"), F.lit(1).cast("long")
    t = F.greatest(one, F.bround(nr * F.lit(float(test_fraction)), 0).cast("long"))
    v = F.greatest(one, F.bround(nr * F.lit(float(val_fraction)), 0).cast("long"))
    tiny = t + v >= nr
    third = F.greatest(one, F.floor(nr / 3))
    t, v = F.when(tiny, third).otherwise(t), F.when(tiny, third).otherwise(v)
    i = F.col("_rn") - 1
    role = (F.when(i >= nr - t, "test").when(i >= nr - t - v, "val")
            .when(i >= nr - t - v - buffer, "purged").otherwise("train"))
    return d.withColumn("fold_id", F.lit(0)).withColumn("role", role).drop("_rn", "_nr")


REGISTRY = {"walk_forward": walk_forward, "super_fold": super_fold, "time": time_split}


def create(name: str):
    if name not in REGISTRY:
        raise ValueError(f"unknown split {name!r}; one of {sorted(REGISTRY)}")
    return REGISTRY[name]


def overlaps(folds: DataFrame, row_key) -> DataFrame:
    """Rows that hold more than one role inside a fold (must be empty)."""
    return (folds.groupBy("fold_id", *row_key).agg(F.count_distinct("role").alias("n_roles"))
            .filter(F.col("n_roles") > 1))


def assert_disjoint(folds: DataFrame, row_key) -> None:
    bad = overlaps(folds, row_key).limit(1).collect()
    if bad:
        raise AssertionError(f"row in several roles of one fold: {bad[0].asDict()}")


def restrict(df: DataFrame, members: DataFrame, on) -> DataFrame:
    """Keep the rows whose key is in ``members`` (left semi join)."""
    return df.join(members.select(*on).distinct(), list(on), "left_semi")


def hash_split(df: DataFrame, keys, id_col: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Shuffled split that is the same on every cluster: order by md5 of seed and id, cut by count."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    d = row_numbers(df.withColumn("_h", h), keys, ["_h"], out="_rn", n="_n")
    role, cum = None, 0.0
    for name, frac in list(fractions.items())[:-1]:
        cum += frac
        cond = F.col("_rn") <= F.floor(F.col("_n") * F.lit(cum))
        role = F.when(cond, name) if role is None else role.when(cond, name)
    last = list(fractions)[-1]
    role = F.lit(last) if role is None else role.otherwise(last)
    return d.withColumn("role", role).drop("_h", "_rn", "_n")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Fold number by group, so that a station never sits on both sides."""
    return df.withColumn("fold_id", (md5_int(F.col(group).cast("string")) % k).cast("int"))


def purge_embargo(df: DataFrame, pos: str, test_lo: int, test_hi: int, gap: int, embargo: int) -> DataFrame:
    """Roles around one test block with purged rows before and embargoed rows after it."""
    p = F.col(pos)
    role = (F.when((p >= test_lo) & (p < test_hi), "test")
            .when((p >= test_lo - gap) & (p < test_lo), "purged")
            .when((p >= test_hi) & (p < test_hi + embargo), "embargo").otherwise("train"))
    return df.withColumn("role", role)
