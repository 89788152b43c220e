"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "gaugeworks", shared: str | None = None) -> SparkSession:
    """A session on this machine; ``shared`` names its folder for stored tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GAUGEWORKS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-gaugeworks-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a session on one machine may lack that setting (a test): it gets a
    temporary folder.  On a cluster, machine-local folders are refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/gaugeworks-{purpose}-{uuid.uuid4().hex}"


def store(df, purpose: str):
    """Write ``df`` to a table in the shared folder and read it back (cuts lineage)."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
