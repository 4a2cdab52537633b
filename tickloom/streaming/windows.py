"""Windowed and stateful operators on streams, and runs of what is available."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.windows import _ema, ema_alpha
from tickloom.storage import shared_dir


def file_stream(spark: SparkSession, path: str, ts: str, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet files of a path (a folder or one file) as a stream; ``ts`` becomes a timestamp."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a single file can't be a base path
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def bars(rows: DataFrame, ts: str, by: list[str], width: str, lateness: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Count, sum, first and last (by event time) per tumbling or sliding window; late rows correct open windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = rows.withWatermark(ts, lateness).groupBy(window, *by)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    return out.select(*by, F.unix_micros("window.start").alias("start_us"), "n", "total", "first", "last")


def sessions(rows: DataFrame, ts: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of a key: rows less than a gap apart."""
    grouped = rows.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *by)
    out = grouped.agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def once_each(rows: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by the lateness."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def stateful_ema(rows: DataFrame, key: str, order: str, value: str, *, period: int | None = None, alpha: float | None = None) -> DataFrame:
    """Exponential averages that go on from batch to batch; rows of a batch are taken in order, later ones as they come."""
    a = ema_alpha(period, alpha)
    kind = dict(rows.dtypes)

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = _ema(pdf[value].to_numpy(float), a, state.get[0] if state.exists else None)
        state.update((float(out[-1]),))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "ema": out})

    schema = f"{key} {kind[key]}, {order} {kind[order]}, {value} {kind[value]}, ema double"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "ema double", "append", GroupStateTimeout.NoTimeout)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes a batch to its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result: all rows (append) or the last table (complete)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tickloom-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(f"{base}/out")(batch, batch_id)
        last.append(batch_id)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    out = f"{base}/out" if mode == "append" else f"{base}/out/batch={last[-1]}"
    return spark.read.parquet(out).select(*stream.columns)


def unacknowledged(outbox: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    """Outbox rows still to be sent: those whose key isn't among the acknowledged."""
    return outbox.join(acks.select(key).distinct(), key, "left_anti")
