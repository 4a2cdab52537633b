"""Arrow tables in and out, and micro-batches from Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.sources.files import from_pandas


def from_arrow(spark: SparkSession, data: pa.Table | pa.RecordBatch, columns: dict[str, str] | None = None, **scales: float) -> DataFrame:
    """Ticks of an Arrow table or batch; options as for from_pandas."""
    table = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
    return from_pandas(spark, table, columns, **scales)


def from_polars(spark: SparkSession, frame: Any, columns: dict[str, str] | None = None, **scales: float) -> DataFrame:
    """Ticks of a polars frame, eager or lazy, over its Arrow form; options as for from_pandas."""
    frame = frame.collect() if hasattr(frame, "collect") else frame
    return from_arrow(spark, frame.to_arrow(), columns, **scales)


def to_polars(df: DataFrame) -> Any:
    """A polars frame; raises ImportError where polars isn't installed."""
    import polars

    return polars.from_arrow(df.toArrow())


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_reader(df: DataFrame) -> pa.RecordBatchReader:
    table = df.toArrow()
    return pa.RecordBatchReader.from_batches(table.schema, table.to_batches())


def to_duckdb(df: DataFrame, name: str, connection: Any = None) -> Any:
    """Registers the table in a DuckDB connection (a new one if none is given) and returns it."""
    import duckdb

    connection = connection or duckdb.connect()
    connection.register(name, df.toArrow())
    return connection


def infer_schema(data: pa.Table) -> dict[str, str]:
    """Column types in the dialect's words; float for what it has none for."""
    out = {}
    for f in data.schema:
        t = f.type
        out[f.name] = (
            "BOOL" if pa.types.is_boolean(t) else "INT32" if pa.types.is_integer(t) and t.bit_width <= 32 else "INT64" if pa.types.is_integer(t)
            else "TIMESTAMP_NS" if pa.types.is_timestamp(t) or pa.types.is_date(t) else "STRING" if pa.types.is_string(t) or pa.types.is_dictionary(t)
            else "FLOAT32" if pa.types.is_float32(t) else "FLOAT64"
        )
    return out


@dataclass
class Progress:
    batches: int = 0
    rows: int = 0
    errors: int = 0


class StreamingSession:
    """Puts rows from Python into a sink in micro-batches, counting what went in and what failed.

    ``sink`` takes a DataFrame and a batch number, as a foreachBatch function does. With ``on_error`` = 'skip' a failed
    batch is counted and left out; with 'raise' it raises.
    """

    def __init__(self, spark: SparkSession, schema: str, sink: Callable[[DataFrame, int], None], *, batch_rows: int = 50_000, on_error: str = "raise") -> None:
        if on_error not in ("raise", "skip"):
            raise ValueError("on_error must be raise or skip")
        self.spark, self.schema, self.sink, self.batch_rows, self.on_error = spark, schema, sink, batch_rows, on_error
        self.progress = Progress()

    def _send(self, rows: Any, n: int) -> None:
        try:
            self.sink(self.spark.createDataFrame(rows, self.schema), self.progress.batches)
            self.progress.batches += 1
            self.progress.rows += n
        except Exception:
            self.progress.errors += 1
            if self.on_error == "raise":
                raise

    def ingest_iter(self, rows: Iterable[tuple]) -> Progress:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= self.batch_rows:
                self._send(held, len(held))
                held = []
        if held:
            self._send(held, len(held))
        return self.progress

    def ingest_pandas(self, pdf: Any) -> Progress:
        for start in range(0, len(pdf), self.batch_rows):
            part = pdf.iloc[start : start + self.batch_rows]
            self._send(part, len(part))
        return self.progress
