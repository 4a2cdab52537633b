"""Parquet files, in-memory frames and partitioned sinks."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.time import wall_ns

CODECS = ("none", "uncompressed", "snappy", "zstd", "lz4_raw", "gzip")


def guarded_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A Parquet file below the working folder: absolute paths, other schemes and ``..`` are refused."""
    if not path or os.path.isabs(path) or "://" in path or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"only relative paths below the working folder are read, not {path!r}")
    df = spark.read.parquet("file://" + os.path.join(os.getcwd(), path))
    return df if limit is None else df.limit(limit)


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def write_parquet(df: DataFrame, path: str, *, codec: str = "snappy", row_group_bytes: int | None = None, mode: str = "errorifexists") -> None:
    if codec.lower() not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    writer = df.write.mode(mode).option("compression", codec.lower())
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def write_hours(df: DataFrame, path: str, ts: str, key: str | None = None, *, codec: str = "zstd", mode: str = "append", files_per_hour: int = 1) -> None:
    """Rows partitioned by hour of ``ts`` (UTC) and sorted by key and time within files.

    An hour's rows are spread over ``files_per_hour`` files by a hash of all columns, so that a full hour isn't one task.
    """
    hour = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd-HH")
    rows = df.withColumn("hour", hour).withColumn("salt_", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_hour)))
    rows = rows.repartition("hour", "salt_").sortWithinPartitions("hour", *([key] if key else []), ts).drop("salt_")
    rows.write.mode(mode).option("compression", codec).partitionBy("hour").parquet(path)


def from_pandas(spark: SparkSession, pdf: Any, columns: dict[str, str] | None = None, *, price: str = "price", price_scale: float = 1, volume: str = "volume", volume_scale: float = 1) -> DataFrame:
    """Ticks of a pandas frame (or Arrow table): columns renamed, price and volume scaled and cut to integers, nulls to 0."""
    df = spark.createDataFrame(pdf)
    df = df.withColumnsRenamed(columns or {})
    for name, scale in ((price, price_scale), (volume, volume_scale)):
        if name in df.columns:
            clean = F.when(F.isnan(F.col(name).cast("double")), 0).otherwise(F.col(name))
            df = df.withColumn(name, F.coalesce((clean * F.lit(scale)).cast("bigint"), F.lit(0).cast("bigint")))
    return df


def to_pandas(df: DataFrame, ts_ns: str | None = None, low_ns: int | None = None, high_ns: int | None = None) -> Any:
    """A pandas frame of a range of nanosecond times, which become UTC timestamps."""
    if ts_ns:
        if low_ns is not None:
            df = df.where(F.col(ts_ns) >= low_ns)
        if high_ns is not None:
            df = df.where(F.col(ts_ns) <= high_ns)
    pdf = df.toPandas()
    if ts_ns:
        import pandas as pd

        pdf[ts_ns] = pd.to_datetime(pdf[ts_ns], utc=True)
    return pdf


def ns_column(df: DataFrame, ts: str, name: str = "ts_ns") -> DataFrame:
    return df.withColumn(name, wall_ns(F.col(ts)))
