"""Table definitions and exports for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Column types of other engines by Spark type.
COLUMN_TYPES = {
    "clickhouse": {"int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "LowCardinality(String)", "boolean": "UInt8", "timestamp": "DateTime64(9)", "timestamp_ntz": "DateTime64(9)", "date": "Date"},
    "timescale": {"int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "string": "TEXT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMPTZ", "date": "DATE"},
    "duckdb": {"int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"},
}


def create_table(df: DataFrame, name: str, engine: str, key: str = "symbol", time: str = "timestamp") -> str:
    """CREATE TABLE for an engine: sorted by key and time, or a hypertable by time."""
    try:
        kinds = COLUMN_TYPES[engine]
    except KeyError:
        raise ValueError(f"unknown engine {engine!r}") from None
    if missing := [k for _, k in df.dtypes if k not in kinds]:
        raise ValueError(f"no type for {missing}")
    columns = ",\n".join(f"  {c} {kinds[k]}" for c, k in df.dtypes)
    sql = f"CREATE TABLE {name} (\n{columns}\n)"
    names = df.columns
    if engine == "clickhouse":
        order = [c for c in (key, time) if c in names]
        part = f" PARTITION BY toYYYYMMDD({time})" if time in names else ""
        return f"{sql} ENGINE = MergeTree(){part} ORDER BY ({', '.join(order) or 'tuple()'})"
    if engine == "timescale" and time in names:
        return f"{sql};\nSELECT create_hypertable('{name}', '{time}')"
    return sql


def continuous_aggregate(name: str, source: str, width: str, key: str = "symbol", time: str = "timestamp") -> str:
    """A continuous OHLCV aggregate for a hypertable."""
    return (
        f"CREATE MATERIALIZED VIEW {name} WITH (timescaledb.continuous) AS\n"
        f"SELECT {key}, time_bucket('{width}', {time}) AS bar, first(price, {time}) AS open, max(price) AS high, min(price) AS low,\n"
        f"  last(price, {time}) AS close, sum(volume) AS volume\nFROM {source} GROUP BY {key}, bar"
    )


def duckdb_import(name: str, path: str) -> str:
    return f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{path}')"
