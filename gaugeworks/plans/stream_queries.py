"""Structured Streaming queries over the event table, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extremes
from ..session import shared_dir
from ..streaming import live
from .base import query, read


def _stream(spark, d):
    schema = read(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))   # event time needs a zoned type


def _latest(df, spark, keys):
    """Drain the source in update mode; the last row written for each key, by batch number.

    Every batch replaces its own folder, so a batch that runs again counts once.
    """
    base = shared_dir(spark, "stream")
    columns = df.columns

    def save(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/e={epoch}")

    q = (df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(f"{df._jdf.schema().toDDL()}, epoch long").option("recursiveFileLookup", "true").parquet(f"{base}/out")
    rest = [c for c in columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return last.select(*keys, "_r.*").select(*columns)


def _keyed_state(spark):
    """Keyed state with timers lives in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("r1_hourly_alerts", """WITH t AS (SELECT event_type, quantile_cont(value, 0.9) AS thr FROM events GROUP BY 1),
    h AS (SELECT date_trunc('hour', ts) AS hour_start, event_type, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT hour_start, event_type, mean_value, n, CAST(mean_value > thr AS INTEGER) AS alert FROM h JOIN t USING (event_type)""", "6: mean_value")
def _(spark, d):
    thr = extremes.threshold(read(spark, d, "events"), ["event_type"], "value")
    return _latest(live.hourly_alerts(_stream(spark, d), thr, "event_type", "ts", "value"), spark, ["hour_start", "event_type"])


@query("r2_antecedent_wetness", """WITH h AS (SELECT event_type, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, sum(value) AS amount FROM events GROUP BY 1, 2),
    s AS (SELECT event_type, min(hour_end) AS lo, max(hour_end) AS last FROM h GROUP BY 1),
    g AS (SELECT s.event_type, last, u.t AS hour_end FROM s, LATERAL (SELECT unnest(generate_series(s.lo, (SELECT max(hour_end) FROM h), INTERVAL 1 HOUR)) AS t) u),
    c AS (SELECT g.event_type, g.hour_end, last, list(coalesce(h.amount, 0)) OVER (PARTITION BY g.event_type ORDER BY g.hour_end ROWS BETWEEN 700 PRECEDING AND CURRENT ROW) AS xs
      FROM g LEFT JOIN h USING (event_type, hour_end))
    SELECT event_type, hour_end, list_reduce(xs, lambda a, x: 0.92 * a + x) AS wetness, hour_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS settled FROM c
    WHERE hour_end <= last OR hour_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", "5: wetness")
def _(spark, d):
    _keyed_state(spark)
    return _latest(live.wetness(_stream(spark, d), "event_type", "ts", "value"), spark, ["event_type", "hour_end"])


@query("r3_running_statistics", """SELECT user_id, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2, CASE WHEN count(value) > 1 THEN var_samp(value) END AS variance
    FROM events GROUP BY 1""", "6: mean; 3: m2 variance")
def _(spark, d):
    _keyed_state(spark)
    return _latest(live.running_moments(_stream(spark, d), "user_id", "value"), spark, ["user_id"])
