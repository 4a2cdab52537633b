"""A pipeline-like class over a session and a lazy column interface."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import xbar
from tickloom.operators import aggs as A
from tickloom.operators import windows as W
from tickloom.sql import Engine


class Pipeline:
    """Ticks (symbol, price, volume, timestamp in ns) that are put in batches and asked by symbol and time."""

    SCHEMA = "symbol bigint, price double, volume bigint, timestamp bigint"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.engine = spark, Engine(spark)
        self._parts: list[DataFrame] = [spark.createDataFrame([], self.SCHEMA)]
        self._waiting: list[tuple[int, float, int, int]] = []

    def ingest(self, symbol: int, price: float, volume: int, timestamp: int) -> None:
        """Keeps a tick until the next drain."""
        self._waiting.append((int(symbol), float(price), int(volume), int(timestamp)))

    def ingest_batch(self, symbols: list[int], prices: list[float], volumes: list[int], timestamps: list[int]) -> None:
        self._waiting += [(int(s), float(p), int(v), int(t)) for s, p, v, t in zip(symbols, prices, volumes, timestamps, strict=True)]

    def ingest_frame(self, df: DataFrame) -> None:
        """Adds a distributed table with the ticks' columns."""
        self.drain()
        self._parts.append(df.selectExpr("cast(symbol AS bigint) AS symbol", "cast(price AS double) AS price", "cast(volume AS bigint) AS volume", "cast(timestamp AS bigint) AS timestamp"))

    def drain(self) -> int:
        """Makes the waiting ticks part of the table; returns how many."""
        n = len(self._waiting)
        if n:
            self._parts.append(self.spark.createDataFrame(self._waiting, self.SCHEMA))
            self._waiting = []
        return n

    def ticks(self, symbol: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
        self.drain()
        df = self._parts[0]
        for part in self._parts[1:]:
            df = df.unionByName(part)
        for cond in (None if symbol is None else F.col("symbol") == symbol, None if low is None else F.col("timestamp") >= low, None if high is None else F.col("timestamp") <= high):
            df = df if cond is None else df.where(cond)
        return df

    def execute(self, sql: str) -> DataFrame:
        self.engine.register("trades", self.ticks())
        return self.engine.sql(sql)

    def count(self, symbol: int | None = None, low: int | None = None, high: int | None = None) -> int:
        return self.ticks(symbol, low, high).count()

    def vwap(self, symbol: int, low: int | None = None, high: int | None = None) -> float | None:
        return self.ticks(symbol, low, high).agg(A.vwap("price", "volume")).first()[0]

    def filter_sum(self, symbol: int, column: str, threshold: float) -> float | None:
        return A.filter_sum(self.ticks(symbol), column, threshold).first()[0]

    def get_column(self, symbol: int, column: str) -> Any:
        """A symbol's column in order of time, as a numpy array."""
        return self.ticks(symbol).orderBy("timestamp").select(column).toPandas()[column].to_numpy()

    def xbar(self, symbol: int, width_ns: int) -> DataFrame:
        return A.ohlcv(self.ticks(symbol), [xbar("timestamp", width_ns).alias("bar")], "price", "volume", ["timestamp"])

    def ema(self, symbol: int, column: str, period: int) -> DataFrame:
        return W.ema(self.ticks(symbol).groupBy("symbol", "timestamp").agg(F.max(column).alias(column)), "symbol", ["timestamp"], column, period=period)

    def delta(self, symbol: int, column: str) -> DataFrame:
        return self.ticks(symbol).withColumn("delta", W.delta(column, Window.partitionBy("symbol").orderBy("timestamp")))

    def ratio(self, symbol: int, column: str) -> DataFrame:
        return self.ticks(symbol).withColumn("ratio", W.ratio(column, Window.partitionBy("symbol").orderBy("timestamp")))

    def window_agg(self, symbol: int, function: str, column: str, rows: int) -> DataFrame:
        """A moving sum, avg, min, max or count over the last rows."""
        if function not in ("sum", "avg", "min", "max", "count"):
            raise ValueError(f"unknown function {function!r}")
        w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(-rows, 0)
        return self.ticks(symbol).withColumn(function, getattr(F, function)(column).over(w))

    def stats(self) -> dict[str, int]:
        df = self.ticks()
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols")).first()
        return {"rows": row["rows"], "symbols": row["symbols"], "batches": len(self._parts) - 1}


class Lazy:
    """``Lazy(df)[Lazy(df)['price'] > x]['volume'].sum().value``: nothing runs before ``collect`` or ``value``."""

    def __init__(self, df: DataFrame, column: Column | None = None, aggregate: Column | None = None) -> None:
        self.df, self.column, self.aggregate = df, column, aggregate
        self._value: Any = None
        self._known = False

    def __getitem__(self, key: str | Lazy) -> Lazy:
        if isinstance(key, str):
            return Lazy(self.df, F.col(key))
        return Lazy(self.df.where(key.column))

    def filter(self, cond: Lazy | str) -> Lazy:
        return Lazy(self.df.where(cond if isinstance(cond, str) else cond.column))

    def _with(self, op: str, other: Any) -> Lazy:
        right = other.column if isinstance(other, Lazy) else F.lit(other)
        return Lazy(self.df, getattr(self.column, op)(right))

    def __gt__(self, other: Any) -> Lazy:
        return self._with("__gt__", other)

    def __lt__(self, other: Any) -> Lazy:
        return self._with("__lt__", other)

    def __ge__(self, other: Any) -> Lazy:
        return self._with("__ge__", other)

    def __le__(self, other: Any) -> Lazy:
        return self._with("__le__", other)

    def __eq__(self, other: object) -> Lazy:  # type: ignore[override]
        return self._with("__eq__", other)

    __hash__ = None  # type: ignore[assignment]

    def __and__(self, other: Lazy) -> Lazy:
        return self._with("__and__", other)

    def __or__(self, other: Lazy) -> Lazy:
        return self._with("__or__", other)

    def _agg(self, c: Column) -> Lazy:
        return Lazy(self.df, self.column, c)

    def sum(self) -> Lazy:
        return self._agg(F.sum(self.column))

    def avg(self) -> Lazy:
        return self._agg(F.avg(self.column))

    def min(self) -> Lazy:
        return self._agg(F.min(self.column))

    def max(self) -> Lazy:
        return self._agg(F.max(self.column))

    def count(self) -> Lazy:
        return self._agg(F.count(F.lit(1)))

    def vwap(self, price: str = "price", volume: str = "volume") -> Lazy:
        return self._agg(A.vwap(price, volume))

    def collect(self) -> Any:
        """The aggregate's value, the column as a numpy array, or the table as a pandas frame."""
        if not self._known:
            if self.aggregate is not None:
                self._value = self.df.agg(self.aggregate).first()[0]
            elif self.column is not None:
                self._value = self.df.select(self.column.alias("x")).toPandas()["x"].to_numpy()
            else:
                self._value = self.df.toPandas()
            self._known = True
        return self._value

    @property
    def value(self) -> Any:
        return self.collect()
