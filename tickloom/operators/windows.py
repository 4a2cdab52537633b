"""Row-to-row functions over ordered sequences of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tickloom.operators.skew import sorted_rows
from tickloom.storage import materialize

#: Fixed-point scale of ratio.
RATIO_SCALE = 1_000_000


def delta(x: Column | str, w: WindowSpec) -> Column:
    """x less the row before; x itself in the first row."""
    x = F.col(x) if isinstance(x, str) else x
    return x - F.lag(x, 1, 0).over(w)


def ratio(x: Column | str, w: WindowSpec) -> Column:
    """x over the row before, in millionths, truncated; a million in the first row, 0 after a 0."""
    x = F.col(x) if isinstance(x, str) else x
    before = F.lag(x).over(w)
    first = F.row_number().over(w) == 1
    return (
        F.when(first, F.lit(RATIO_SCALE).cast("bigint"))
        .when(before == 0, F.lit(0).cast("bigint"))
        .otherwise((x.cast("double") / F.when(before != 0, before).cast("double") * RATIO_SCALE).cast("bigint"))
    )


def window_function(name: str, x: Column | str | None, w: WindowSpec, n: int = 1) -> Column:
    """A window function by name; ``n`` is the distance of lag and lead (which default to 0) and the buckets of ntile."""
    made = {
        "row_number": lambda: F.row_number().over(w), "rank": lambda: F.rank().over(w), "dense_rank": lambda: F.dense_rank().over(w), "ntile": lambda: F.ntile(n).over(w),
        "sum": lambda: F.sum(x).over(w), "avg": lambda: F.avg(x).over(w), "min": lambda: F.min(x).over(w), "max": lambda: F.max(x).over(w), "count": lambda: F.count(x).over(w),
        "lag": lambda: F.lag(x, n, 0).over(w), "lead": lambda: F.lead(x, n, 0).over(w), "delta": lambda: delta(x, w), "ratio": lambda: ratio(x, w),
    }
    if name.lower() not in made:
        raise ValueError(f"unknown window function {name!r}")
    return made[name.lower()]()


def ema_alpha(period: int | None = None, alpha: float | None = None) -> float:
    """Smoothing factor: the given one, 2 / (period + 1), or 0.1."""
    a = alpha if alpha is not None else 2.0 / (period + 1) if period is not None else 0.1
    if not 0 < a <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return a


def _ema(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """Exponential average of a stretch, going on from ``start`` (the value before) or from the first value."""
    if not len(x):
        return x
    seed = x[0] if start is None or np.isnan(start) else start
    first = x[0] if start is None or np.isnan(start) else alpha * x[0] + (1 - alpha) * seed
    return pd.Series(np.concatenate([[first], x[1:]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def ema(
    df: DataFrame, key: str, order: list[str], value: str, *, period: int | None = None, alpha: float | None = None, partitions: int | None = None
) -> DataFrame:
    """Exponential moving average of each key: e0 = x0, then e = alpha * x + (1 - alpha) * e.

    A stretch of n rows maps the average before it linearly to the one after it (a + b * e with b = (1 - alpha)**n).
    Rows are range-partitioned and sorted by (key, order), so only a partition's first key may have begun before it: its rows
    are averaged from 0, all others from their key's first value, and written once, batch by batch, whatever the partition's
    size. The ends of the stretches are then chained, and a row of a first key gets the average carried into its partition by its own
    weight. No key is gathered in a task. Columns: key, the order columns, the value and ``ema``. Rows with a null key or
    value don't take part; of rows equal in (key, order) one counts, that of the smallest value.
    """
    a = ema_alpha(period, alpha)
    rows = sorted_rows(df.where(F.col(value).isNotNull()), key, order, [value], partitions)
    names = [c for c in rows.columns if c.startswith("o")]
    rows = rows.select("k", *names, F.col("v0").cast("double").alias("v0"))
    told = [("ema", DoubleType()), ("part", IntegerType()), ("i", LongType())]
    out = StructType([*rows.schema.fields, *(StructField(c, t) for c, t in told)])
    local = materialize(rows.mapInArrow(lambda batches: _averages(batches, a), out), "averages")
    # first and last row of the stretches that may go on from a partition before, or into the next
    ends = local.groupBy("k", "part").agg(F.max("i").alias("last"), F.max_by("ema", "i").alias("a"), F.min_by("v0", "i").alias("x0"), F.min("i").alias("least"))
    over = Window.partitionBy("k")
    ends = ends.withColumn("parts", F.count(F.lit(1)).over(over)).where((F.col("parts") > 1) | (F.col("least") < FIRST + 1))
    carry = ends.select("k", "part", "last", "a", "x0", "least").groupBy("k").applyInPandas(_chain(a), "part int, carry double")
    # one row for each partition at most
    joined = local.join(F.broadcast(carry), "part", "left")
    weight = F.pow(F.lit(1 - a), (F.col("i") - (FIRST - 1)).cast("double"))
    done = F.when(F.col("i") >= 0, F.col("ema")).otherwise(F.col("ema") + weight * F.col("carry"))
    return joined.select(F.col("k").alias(key), *(F.col(n).alias(c) for n, c in zip(names, order, strict=True)), F.col("v0").alias(value), done.alias("ema"))


#: Rows of a partition's first key are numbered from here, those of other keys from 0.
FIRST = -(2**62)


def _runs(column: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _averages(batches: Iterator[pa.RecordBatch], a: float) -> Iterator[pa.RecordBatch]:
    """The averages of a partition's rows, with the partition and the row's number in its stretch."""
    part = TaskContext.get().partitionId()
    before: tuple[object, float, int] | None = None  # key, average and number of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        k, x = batch.column("k").to_numpy(zero_copy_only=False), batch.column("v0").to_numpy()
        out, number = np.empty(len(x)), np.empty(len(x), np.int64)
        cut = _runs(k)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if before is None:
                start, i = 0.0, FIRST
            elif before[0] == k[lo]:
                start, i = before[1], before[2] + 1
            else:
                start, i = None, 0
            out[lo:hi] = _ema(x[lo:hi], a, start)
            number[lo:hi] = np.arange(i, i + hi - lo)
            before = (k[hi - 1], out[hi - 1], i + hi - lo - 1)
        more = (pa.array(out), pa.array(np.full(len(x), part, np.int32)), pa.array(number))
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ema", "part", "i"])


def _chain(a: float):
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """The average carried into each partition whose first key is this one: that of the last row before, or the key's first value."""
        pdf = pdf.sort_values("part")
        parts, carry, state = [], [], None
        for part, last, s, x0, least in zip(pdf["part"], pdf["last"], pdf["a"], pdf["x0"], pdf["least"], strict=True):
            if least < 0:
                # the very first value counts with its full weight
                state = x0 if state is None else state
                parts.append(part)
                carry.append(state)
                state = s + (1 - a) ** (last - FIRST + 1) * state
            else:
                state = s
        return pd.DataFrame({"part": np.array(parts, np.int32), "carry": np.array(carry, float)})

    return chain
