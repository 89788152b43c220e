"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..contracts import assert_contract


def scan(spark: SparkSession, path: str, contract=None, fmt: str = "parquet", rename: dict[str, str] | None = None) -> DataFrame:
    """Read a table, rename columns, keep and check the contract's columns (pruned at the scan)."""
    df = spark.read.format(fmt).load(path)
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    return assert_contract(df, contract) if contract else df


def scan_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """A JSON file that is one object keyed by record id -> one row per record.

    One such file is one document, so it is read by one task; many files spread.
    """
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{value_schema}>")
    return text.select(F.explode(m).alias(key, "_v")).select(key, "_v.*")


def json_map(text: Column, value_schema: str) -> Column:
    return F.from_json(text, f"map<string,{value_schema}>")


def scan_results(spark: SparkSession, path: str, item_schema: str, field: str = "results") -> DataFrame:
    """Saved API pages with an array of results -> one row per result."""
    pages = spark.read.schema(f"{field} array<{item_schema}>").option("multiLine", "true").json(path)
    return pages.select(F.explode(field).alias("_r")).select("_r.*")


def scan_whitespace(spark: SparkSession, path: str, columns: dict[str, str], skip_prefix: str = "#") -> DataFrame:
    """Text columns separated by any run of white space; ``columns`` = {name: type} in order."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith(skip_prefix))
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())])


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float column."""
    fl = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fl})


def write_metrics(long_rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """(experiment, method, metric, value) rows, partitioned by experiment."""
    long_rows.select("experiment", "method", "metric", "value").write.mode(mode).partitionBy("experiment").format(fmt).save(path)


def provenance(spark: SparkSession, path: str, source: str, query: dict[str, str]) -> DataFrame:
    """File manifest: size, time, sha256 of the content and a cache key of the query."""
    files = spark.read.format("binaryFile").load(path)
    q = F.create_map(*[F.lit(x) for kv in sorted(query.items()) for x in kv])
    return files.select("path", F.col("length").alias("bytes"), "modificationTime", F.sha2("content", 256).alias("sha256"),
                        F.lit(source).alias("source"), F.sha2(F.to_json(q), 256).alias("cache_key"))
