"""Structured Streaming forms of three batch operators for live networks.

All three run in update mode: an hour still open shows its value so far, and a later
row of the same key and hour takes its place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

HOUR = 3_600_000_000   # microseconds


def hourly_alerts(stream: DataFrame, thresholds: DataFrame, station: str, ts: str, value: str,
                  late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Hourly station means with late data and an exceedance flag from a static threshold table.

    The watermark only says when an hour is settled and its state can go.
    """
    agg = (stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), station)
           .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")))
    return (agg.join(thresholds, station)
            .select(F.col("w.start").alias("hour_start"), station, "mean_value", "n",
                    (F.col("mean_value") > F.col("threshold")).cast("int").alias("alert")))


def _merged(n, mean, m2, k, other, o2):
    """Count, mean and sum of squared deviations of two groups together."""
    total, gap = n + k, other - mean
    return total, mean + gap * (k / total), m2 + o2 + gap * gap * (n * (k / total))


class Moments(StatefulProcessor):
    """Running count, mean and squared deviations of one key."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues):
        now = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.n:
                    now = _merged(*now, int(r.n), float(r.mean), float(r.m2))
        now = int(now[0]), float(now[1]), float(now[2])
        self.state.update(now)
        yield pd.DataFrame({"key": [key[0]], "n": [now[0]], "mean": [now[1] if now[0] else None], "m2": [now[2] if now[0] else None]})


def running_moments(stream: DataFrame, station: str, value: str) -> DataFrame:
    """Count, mean, squared deviations ``m2`` and ``variance`` (of the sample) per station, kept as mergeable state.

    Each task of a batch first reduces its rows to one row a station, so a busy
    station costs no more than a quiet one; nothing cancels where the mean is large.
    """
    kind = stream.schema[station].dataType.simpleString()

    def part(batches):
        for pdf in batches:
            g = pdf.groupby("key", dropna=False)["v"]
            out = g.agg(["count", "mean"]).reset_index()
            gap = pdf["v"] - g.transform("mean")
            out["m2"] = (gap * gap).groupby(pdf["key"], dropna=False).sum().to_numpy()
            yield out.rename(columns={"count": "n"})[["key", "n", "mean", "m2"]]

    parts = stream.select(F.col(station).alias("key"), F.col(value).cast("double").alias("v")).mapInPandas(part, f"key {kind}, n long, mean double, m2 double")
    out = parts.groupBy("key").transformWithStateInPandas(Moments(), f"key {kind}, n long, mean double, m2 double", "Update", "None")
    return out.select(F.col("key").alias(station), "n", "mean", "m2", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).alias("variance"))


class Wetness(StatefulProcessor):
    """Wetness at the last settled hour and the rain of the hours after it, of one gauge."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "hour long, wet double")
        self.open = handle.getMapState("open", "hour long", "amount double")

    def _rows(self, key, watermark_ms: int):
        """Rows of the hours that settle now and of those still open; keeps what the next batch needs."""
        rain = {int(k[0]): float(v[0]) for k, v in self.open.iterator()}
        if self.settled.exists():
            hour, wet = self.settled.get()
        elif rain:
            hour, wet = min(rain) - 1, 0.0
        else:
            return
        hour, wet, last = int(hour), float(wet), int(watermark_ms * 1000 // HOUR)
        out = []
        while hour < last:                       # settled: their end lies behind the watermark
            hour += 1
            wet = self.decay * wet + rain.pop(hour, 0.0)
            if self.open.containsKey((hour,)):
                self.open.removeKey((hour,))
            out.append((hour, wet, True))
        self.settled.update((hour, wet))
        for h in range(hour + 1, max(rain, default=hour) + 1):
            wet = self.decay * wet + rain.get(h, 0.0)
            out.append((h, wet, False))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer((hour + 1) * HOUR // 1000)
        if out:
            hours, values, final = zip(*out)
            yield pd.DataFrame({"key": [key[0]] * len(out), "hour_end": [h * HOUR for h in hours], "wetness": values, "settled": final})

    def handleInputRows(self, key, rows, timerValues):
        done = int(self.settled.get()[0]) if self.settled.exists() else None
        for pdf in rows:
            for hour, amount in pdf.groupby("hour")["amount"].sum().items():
                if done is None or hour > done:
                    k = (int(hour),)
                    before = float(self.open.getValue(k)[0]) if self.open.containsKey(k) else 0.0
                    self.open.updateValue(k, (before + float(amount),))
        yield from self._rows(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._rows(key, timerValues.getCurrentWatermarkInMs())


def wetness(stream: DataFrame, gauge: str, ts: str, precip: str, decay: float = 0.92, late: str = "1 hour") -> DataFrame:
    """Antecedent wetness per gauge at the end of every hour from its first rain on: w = decay * w + rain of the hour.

    One number a gauge is kept, with the rain of hours that are still open.  An hour
    settles when the watermark passes its end, also without new readings (a timer);
    open hours are shown up to the gauge's last reading.  Tasks first sum their rows
    by gauge and hour.  Rows without a time or behind the watermark take no part; a null
    amount is no rain.
    """
    kind = stream.schema[gauge].dataType.simpleString()

    def part(batches):
        for pdf in batches:
            pdf = pdf[pdf["us"].notna()]
            hour = pdf["us"].astype("int64") // HOUR + 1
            g = pdf.assign(hour=hour).groupby(["key", "hour"], dropna=False)
            out = g.agg(amount=("amount", "sum"), ts=("ts", "max")).reset_index()
            yield out[["key", "hour", "amount", "ts"]]

    rows = stream.select(F.col(gauge).alias("key"), F.unix_micros(ts).alias("us"), F.coalesce(F.col(precip).cast("double"), F.lit(0.0)).alias("amount"), F.col(ts).alias("ts"))
    parts = rows.mapInPandas(part, f"key {kind}, hour long, amount double, ts timestamp").withWatermark("ts", late)
    out = parts.groupBy("key").transformWithStateInPandas(Wetness(decay), f"key {kind}, hour_end long, wetness double, settled boolean", "Update", "EventTime")
    return out.select(F.col("key").alias(gauge), F.timestamp_micros("hour_end").alias("hour_end"), "wetness", "settled")
