"""Irregular readings onto a regular grid.

Every source is cut into time shards. Readings are first reduced to one row per period (partial aggregation
before the shuffle, keyed by source and period, so a busy source spreads over its periods). Each shard is then
summarised by its first and last reading; a prefix scan over the summaries hands every shard the state carried
into it; and all shards, those without any reading included, are filled independently of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import floor_div
from tickloom.functions.time import micros

READING, GAP, CARRIED = "reading", "gap", "carried"


def regular_grid(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    *,
    tie: str | None = None,
    period_s: int = 300,
    shard_s: int = 86_400,
    valid: Column | None = None,
) -> DataFrame:
    """One row per source and period from the source's first to its last reading.

    Columns: the key, ``period_start_s`` (seconds since the epoch), ``value`` (the period's last reading by
    time, then ``tie``, then value; in a period without reading the last one before it), ``n_readings`` and
    ``state``: ``reading``, ``gap`` (no reading, between the first and last reading of its shard) or
    ``carried`` (no reading, filled across a shard's boundary).

    Rows with a null key, time or value, and those for which ``valid`` isn't true, are no readings. Repeated
    rows change only ``n_readings``. Empty input gives no rows. Other columns of the input are ignored, so
    their names cannot clash.
    """
    if period_s <= 0 or shard_s % period_s:
        raise ValueError("shard_s must be a positive multiple of period_s")
    per_shard = shard_s // period_s
    us = micros(F.col(ts))
    ok = F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()
    order = [us] + ([F.col(tie)] if tie else []) + [F.col(value)]
    readings = df.where(ok if valid is None else ok & valid).select(
        F.col(key).alias("k"), floor_div(us, 1_000_000 * period_s).alias("p"), F.struct(*order).alias("o"), F.col(value).alias("v")
    )
    periods = (
        readings.groupBy("k", "p")
        .agg(F.max_by("v", "o").alias("v"), F.count(F.lit(1)).alias("n"))
        .withColumn("shard", floor_div("p", per_shard))
    )
    inside = Window.partitionBy("k", "shard").orderBy("p")
    shards = periods.select(
        "k", "shard", "p", "v", "n", F.lag("p").over(inside).alias("prior_p"), F.lead("p").over(inside).alias("next_p")
    )
    # summaries come from the first and last row of each shard, so both sides read one exchange and the input once
    ends = shards.where(F.col("prior_p").isNull() | F.col("next_p").isNull())
    bounds = ends.groupBy("k", "shard").agg(F.min("p").alias("first_p"), F.max("p").alias("last_p"), F.max_by("v", "p").alias("last_v"))
    along = Window.partitionBy("k").orderBy("shard")
    carried = bounds.select(
        "k", "shard", "first_p", "last_p",
        F.lag("shard").over(along).alias("from_shard"),
        F.lag("last_p").over(along).alias("from_p"),
        F.lag("last_v").over(along).alias("from_v"),
    )
    none = F.lit(None).cast("bigint")
    filled = shards.select(
        "k", "v", "n", F.col("p").alias("lo"), (F.coalesce(F.col("next_p"), F.col("p") + 1) - 1).alias("hi"),
        F.col("p").alias("first_p"), F.coalesce("next_p", "p").alias("last_p"),
    )
    # the carry fills the rest of the shard it comes from, whole shards without readings, and the start of the next
    crossing = (
        carried.where(F.col("from_p").isNotNull())
        .select("k", "first_p", "from_p", "from_v", F.explode(F.sequence("from_shard", "shard")).alias("s"))
        .repartition("k", "s")  # a long silence becomes many shards, which are filled apart
        .select(
            "k", F.col("from_v").alias("v"), F.lit(0).cast("bigint").alias("n"),
            F.greatest(F.col("from_p") + 1, F.col("s") * per_shard).alias("lo"),
            F.least(F.col("first_p") - 1, F.col("s") * per_shard + (per_shard - 1)).alias("hi"),
            none.alias("first_p"), none.alias("last_p"),
        )
        .where("lo <= hi")
    )
    grid = filled.unionByName(crossing).select("*", F.explode(F.sequence("lo", "hi")).alias("period"))
    is_reading = F.col("period") == F.col("first_p")  # NULL in what is carried over a boundary
    within = F.col("period").between(F.col("first_p"), F.col("last_p"))
    return grid.select(
        F.col("k").alias(key),
        (F.col("period") * period_s).alias("period_start_s"),
        F.col("v").alias("value"),
        F.when(is_reading, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("n_readings"),
        F.when(is_reading, F.lit(READING)).when(within, F.lit(GAP)).otherwise(F.lit(CARRIED)).alias("state"),
    )
