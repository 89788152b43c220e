"""Table contracts: the column names and types each operator family expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string as ddl

CONTRACTS = {
    "daily_series": "series_id string, date date, value double",
    "hourly_air_quality": ("station string, ts timestamp, pm25 double, wind double, temp double, boundary_layer double, "
                           "hour double, dow double, is_weekend double"),
    "catchment": "gauge_id string, date date, precip double, temperature double, pet double, streamflow double",
    "observations": "station bigint, obs_idx int, value double",
    "presence": "x double, y double, temperature double, precipitation double, elevation double, y_label int",
    "stations": "id bigint, x double, y double, cov double, value double",
    "grid": "cell_id bigint, x double, y double, cov double, truth double",
    "field": "lat double, lon double, value double",
    "patches": "patch_id bigint, label int, blue array<float>, green array<float>, red array<float>, nir array<float>, swir array<float>",
    "comments": "id bigint, text string, interactions array<struct<subject:string,relation:string,object:string>>",
    "events": "id string, event string, location string, cause string, caused_by string",
    "predictions": "key string, ts timestamp, method string, horizon int, y_true double, y_pred double",
    "intervals": "key string, ts timestamp, method string, level double, y_true double, y_pred double, lower double, upper double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class ContractError(ValueError):
    pass


def schema(name: str) -> StructType:
    return ddl(CONTRACTS[name])


def assert_contract(df: DataFrame, contract) -> DataFrame:
    """Return ``df`` reduced to the contract's columns; raise on a missing or mistyped one."""
    want = schema(contract) if isinstance(contract, str) and contract in CONTRACTS else (ddl(contract) if isinstance(contract, str) else contract)
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}"
           for f in want.fields if have.get(f.name) is None or have[f.name].simpleString() != f.dataType.simpleString()]
    if bad:
        raise ContractError("; ".join(bad))
    return df.select(*[f.name for f in want.fields])
