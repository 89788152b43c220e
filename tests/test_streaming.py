"""Streams in several batches against plain loops: late rows, silent gauges, open hours, null values, readings far from zero."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.plans.stream_queries import _keyed_state, _latest
from gaugeworks.session import shared_dir
from gaugeworks.streaming import live

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "gauge string, ts timestamp, v double"


def _stream(spark, batches):
    """One file a batch, read in order."""
    folder = shared_dir(spark, "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _at(hours):
    return START + dt.timedelta(hours=hours)


def test_wetness_over_batches(spark):
    _keyed_state(spark)
    batches = [
        [("a", _at(0.5), 10.0), ("a", _at(0.6), 2.0), ("b", _at(1.2), 5.0), ("a", None, 9.0), (None, _at(1.5), 4.0)],
        [("a", _at(3.5), None), ("a", _at(2.9), 1.0), ("b", _at(3.9), 1.0)],     # 2.9 is late but not behind the watermark
        [("a", _at(8.25), 7.0)],                                                  # b and null stay silent
        [("a", _at(2.5), 100.0), ("a", _at(9.5), 3.0)],                           # 2.5 is behind the watermark
    ]
    out = _latest(live.wetness(_stream(spark, batches), "gauge", "ts", "v", 0.9, "1 hour"), spark, ["gauge", "hour_end"])
    got = {(r["gauge"], r["hour_end"].timestamp()): (r["wetness"], r["settled"]) for r in out.withColumn("hour_end", F.col("hour_end")).collect()}
    rain = {"a": {1: 12.0, 3: 1.0, 9: 7.0, 10: 3.0}, "b": {2: 5.0, 4: 1.0}, None: {2: 4.0}}
    last = {"a": 10, "b": 8, None: 8}                                             # the watermark ends at 8.5
    want = {}
    for k, r in rain.items():
        wet = 0.0
        for h in range(min(r), last[k] + 1):
            wet = 0.9 * wet + r.get(h, 0.0)
            want[k, _at(h).timestamp()] = (pytest.approx(wet), h <= 8)
    assert got == want


def test_moments_do_not_cancel(spark):
    _keyed_state(spark)
    r = np.random.default_rng(4)
    batches = [[(k, _at(0), float(x)) for k in ("a", None) for x in 1e9 + r.normal(size=200)] + [("c", _at(0), None)] for _ in range(3)]
    out = _latest(live.running_moments(_stream(spark, batches), "gauge", "v"), spark, ["gauge"])
    got = {x["gauge"]: x for x in out.collect()}
    assert got.keys() == {"a", None, "c"} and got["c"]["n"] == 0 and got["c"]["mean"] is None
    for k in ("a", None):
        v = pd.Series([x[2] for b in batches for x in b if x[0] == k and x[2] is not None])
        assert got[k]["n"] == len(v) and got[k]["mean"] == pytest.approx(v.mean(), rel=1e-15) and got[k]["variance"] == pytest.approx(v.var(), rel=1e-9)


def test_open_hours_are_shown(spark):
    batches = [[("a", _at(0.5), 1.0)], [("a", _at(0.7), 3.0), ("a", _at(5.5), 9.0)]]
    thr = spark.createDataFrame([("a", 1.5)], "gauge string, threshold double")
    out = _latest(live.hourly_alerts(_stream(spark, batches), thr, "gauge", "ts", "v"), spark, ["hour_start", "gauge"])
    assert sorted((r["mean_value"], r["n"], r["alert"]) for r in out.collect()) == [(2.0, 2, 1), (9.0, 1, 1)]
