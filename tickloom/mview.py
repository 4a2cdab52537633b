"""Materialized views of bars: partial states that are merged as batches arrive, and rolled up to coarser bars."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import epoch_s, xbar
from tickloom.functions.time import wall_ns


@dataclass(frozen=True)
class BarsView:
    """Bars of a width in seconds by key. A state holds one row per key and bar and merges in any order."""

    key: str
    ts: str
    price: str
    volume: str
    tie: tuple[str, ...]
    width_s: int

    def partial(self, rows: DataFrame) -> DataFrame:
        """State of a batch of rows; combined on the map side."""
        order = F.struct(F.col(self.ts), *self.tie)
        both = F.col(self.price).cast("double") * F.col(self.volume)
        bar = xbar(epoch_s(wall_ns(F.col(self.ts))), self.width_s)
        point = F.struct(order.alias("o"), F.col(self.price).alias("p"))
        return rows.groupBy(F.col(self.key), bar.alias("bar")).agg(
            F.min(point).alias("first"), F.max(point).alias("last"), F.max(self.price).alias("high"), F.min(self.price).alias("low"),
            F.sum(self.volume).alias("volume"), F.sum(both).alias("pv"), F.count(F.lit(1)).alias("n"),
        )

    def merge(self, *states: DataFrame) -> DataFrame:
        """One state of several."""
        rows = states[0]
        for s in states[1:]:
            rows = rows.unionByName(s)
        return rows.groupBy(self.key, "bar").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.sum("volume").alias("volume"), F.sum("pv").alias("pv"), F.sum("n").alias("n"),
        )

    def rolled(self, state: DataFrame, width_s: int) -> DataFrame:
        """The state of coarser bars, from this one, without the rows."""
        if width_s % self.width_s:
            raise ValueError("the coarser width must be a multiple of the finer")
        return self.coarser(width_s).merge(state.withColumn("bar", xbar("bar", width_s)))

    def coarser(self, width_s: int) -> BarsView:
        return replace(self, width_s=width_s)

    def final(self, state: DataFrame) -> DataFrame:
        """Open, high, low, close, volume, vwap and n of each bar."""
        return state.select(
            self.key, "bar", F.col("first.p").alias("open"), "high", "low", F.col("last.p").alias("close"), "volume",
            F.when(F.col("volume") > 0, F.col("pv") / F.col("volume")).alias("vwap"), "n",
        )

    def answers(self, key: str, width_s: int, aggs: set[str]) -> bool:
        """Whether a query by key and bar width can be read from this view instead of the rows."""
        return key == self.key and width_s % self.width_s == 0 and aggs <= {"open", "high", "low", "close", "volume", "vwap", "n"}


def bars_view(key: str, ts: str, price: str, volume: str, tie: list[str], width_s: int) -> BarsView:
    return BarsView(key, ts, price, volume, tuple(tie), width_s)
