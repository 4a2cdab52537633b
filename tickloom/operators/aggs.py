"""Aggregates of tick analytics, combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.storage import PARTITION_BYTES, estimated_bytes, materialize, partitions_for

def vwap(price: Column | str, volume: Column | str) -> Column:
    """Volume-weighted average price; NULL unless the volume is positive. Rows lacking either don't count."""
    p, v = (F.col(c) if isinstance(c, str) else c for c in (price, volume))
    both = p.isNotNull() & v.isNotNull()
    total = F.sum(F.when(both, v))
    return F.when(total > 0, F.sum(p.cast("double") * v) / F.when(total > 0, total))


def first_by(value: str, *order: str) -> Column:
    """The value of the row that comes first by the order columns."""
    return F.min_by(value, F.struct(*order) if len(order) > 1 else F.col(order[0]))


def last_by(value: str, *order: str) -> Column:
    """The value of the row that comes last by the order columns."""
    return F.max_by(value, F.struct(*order) if len(order) > 1 else F.col(order[0]))


def ohlcv(df: DataFrame, by: list[str | Column], price: str, volume: str, order: list[str]) -> DataFrame:
    """Open, high, low, close, volume, vwap and count per group; open and close by the order columns."""
    return df.where(F.col(price).isNotNull()).groupBy(*by).agg(
        first_by(price, *order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last_by(price, *order).alias("close"),
        F.sum(volume).alias("volume"), vwap(price, volume).alias("vwap"), F.count(F.lit(1)).alias("n"),
    )


def percentile_lower(df: DataFrame, by: list[str], value: str, percents: list[int], partitions: int | None = None) -> DataFrame:
    """Lower nearest-rank percentiles: the value at position floor(p * (n - 1) / 100) of the non-null ones, from 0.

    Equal values are first counted (combined before the shuffle), so a group's cost is that of its distinct
    values. Where these may be more than a partition holds, they are range-partitioned by (group, value) and written once; the
    partitions' totals tell in which of them a rank lies, and only those are ranked, each by itself. No group, and not the
    whole table, is gathered in a task. Columns: the group, ``n``, ``p<percent>``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c_"))
    share = estimated_bytes(counts) // PARTITION_BYTES + 1 if partitions is None else partitions
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    rank = {p: F.call_function("div", F.lit(p) * (F.col("n_") - 1), F.lit(100).cast("bigint")) for p in percents}
    if share == 1:
        ranked = counts.select(*by, value, F.sum("c_").over(group.orderBy(value)).alias("upto_"), F.sum("c_").over(group).alias("n_"))
    else:
        parts = materialize(counts.repartitionByRange(partitions_for(counts, partitions), *by, value).withColumn("part_", F.spark_partition_id()), "counts")
        # one row for each group and partition it reaches into
        sums = parts.groupBy(*by, "part_").agg(F.sum("c_").alias("s_"))
        sums = sums.select("*", (F.sum("s_").over(group.orderBy("part_")) - F.col("s_")).alias("base_"), F.sum("s_").over(group).alias("n_"))
        hit = F.lit(False)
        for r in rank.values():
            hit = hit | ((r >= F.col("base_")) & (r < F.col("base_") + F.col("s_")))
        told = sums.where(hit).select(*[F.col(c).alias(f"{c}_k") for c in by], F.col("part_").alias("part_k"), "base_", "n_")
        same = F.col("part_") == F.col("part_k")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
        inside = Window.partitionBy(*by, "part_").orderBy(value)
        ranked = parts.join(told, same).select(*by, value, "n_", (F.col("base_") + F.sum("c_").over(inside)).alias("upto_"))
    # within a partition the first value past the rank is the one; earlier partitions end before it
    picks = [F.min(F.when(F.col("upto_") > r, F.col(value))).alias(f"p{p}") for p, r in rank.items()]
    return ranked.groupBy(*by).agg(F.max("n_").alias("n"), *picks)


def filter_sum(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Sum of a column over the rows in which it exceeds a threshold."""
    return df.where(F.col(column) > threshold).agg(F.sum(column).alias("total"))
