"""Joins of the tick dialect that the engine's own joins don't cover.

Time-ordered joins are cut into buckets of (key, time), so that a busy key is spread over its time. What a bucket needs from
before its start is carried by a running maximum over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import floor_div



def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    *,
    take: list[str] | None = None,
    how: str = "inner",
    bucket: int,
    tie: list[str] | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Times are integers in one unit, ``bucket`` the width of a time bucket in it. ``take`` names the right
    columns to bring (all but the keys by default; those that clash get ``suffix``). Of several right rows at
    one time the greatest by ``tie``, then by the taken columns, is taken. ``how`` is inner (unmatched left
    rows dropped) or left. Rows with a null key or time never match; repeated left rows all come out.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    take = [c for c in right.columns if c not in on] if take is None else take
    names = {c: (c + suffix if c in left.columns else c) for c in take}
    usable = F.lit(True)
    for c in on:
        usable = usable & F.col(c).isNotNull()
    body = F.struct(*[F.col(c).alias(c) for c in left.columns])
    load = F.struct(F.col(right_ts).alias("t"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(tie or [])], *[F.col(c).alias(f"r{i}") for i, c in enumerate(take)])
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
    keys = [f"k{i}" for i in range(len(on))]
    lhs = left.select(*key, F.col(left_ts).alias("t"), F.lit(1).alias("side"), body.alias("l"), F.lit(None).cast(right.select(load.alias("r")).schema["r"].dataType).alias("r"))
    rhs = right.where(usable & F.col(right_ts).isNotNull()).select(
        *key, F.col(right_ts).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(lhs.schema["l"].dataType).alias("l"), load.alias("r")
    )
    rows = lhs.where(F.col("t").isNotNull()).unionByName(rhs).withColumn("b", floor_div("t", bucket))
    inside = Window.partitionBy(*keys, "b").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.last("r", True).over(inside).alias("m")).where("side = 1")
    ends = rhs.withColumn("b", floor_div("t", bucket)).groupBy(*keys, "b").agg(F.max("r").alias("end"))
    # the buckets in which left rows lie, with the last right row of any bucket before
    need = lhs.where(F.col("t").isNotNull()).select(*keys, floor_div("t", bucket).alias("b"), F.lit(1).alias("side")).distinct()
    marks = need.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)).unionByName(ends.withColumn("side", F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("b").rangeBetween(Window.unboundedPreceding, -1)
    carry = marks.select(*keys, "b", "side", F.max("end").over(before).alias("carry")).where("side = 1").drop("side")
    same = [F.col("local." + k).eqNullSafe(F.col("carry." + k)) for k in [*keys, "b"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    met = local.alias("local").join(carry.alias("carry"), cond, "left").select("local.l", F.coalesce("local.m", "carry.carry").alias("m"))
    missing = left.where(F.col(left_ts).isNull()).select(body.alias("l"), F.lit(None).cast(met.schema["m"].dataType).alias("m"))
    out = met.where(F.col("m").isNotNull()) if how == "inner" else met.unionByName(missing)
    return out.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *[F.col(f"m.r{i}").alias(names[c]) for i, c in enumerate(take)])


def aj0(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, **options: object) -> DataFrame:
    """The left rows that have an as-of partner, without the right columns."""
    return asof_join(left, right, on, left_ts, right_ts, take=[], how="inner", **options)


def window_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    before: int,
    after: int,
    aggs: dict[str, tuple[str, str]],
    *,
    empty: str = "zero",
) -> DataFrame:
    """Every left row with aggregates of the right rows of its key in [time - before, time + after].

    ``aggs`` maps an output name to (function, right column); functions: avg, sum, count, min, max. A window
    without right rows gives 0 (``empty='zero'``) or NULL (``empty='null'``; counts stay 0). Left rows with a
    null key or time have an empty window. Times are integers.

    Both sides are stacked in time buckets at least as wide as the window, right rows also in the buckets that
    their windows reach, and aggregated by a range frame: no pairs are made, and repeated left rows cost nothing more.
    """
    width = max(before + after + 1, 1)
    keys = [f"k{i}" for i in range(len(on))]
    key = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    columns = sorted({c for _, c in aggs.values()})
    usable = F.col(right_ts).isNotNull()
    for c in on:
        usable = usable & F.col(c).isNotNull()
    values = [F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]
    body = F.struct(*[F.col(c).alias(c) for c in left.columns])
    lhs = left.select(*key, F.col(left_ts).cast("bigint").alias("t"), body.alias("l")).select("*", floor_div("t", width).alias("b"))
    rhs = right.where(usable).select(*key, F.col(right_ts).cast("bigint").alias("t"), *values).select(
        *keys, "t", *[f"v{i}" for i in range(len(columns))],
        F.explode(F.sequence(floor_div(F.col("t") - after, width), floor_div(F.col("t") + before, width))).alias("b"),
    )
    rows = lhs.withColumn("side", F.lit(1)).unionByName(rhs.withColumn("side", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(*keys, "b").orderBy("t").rangeBetween(-before, after)
    out = []
    for name, (fn, column) in aggs.items():
        value = F.when(F.col("side") == 0, F.col(f"v{columns.index(column)}"))
        agg = getattr(F, fn)(value).over(frame)
        if fn == "count" or empty == "zero":
            agg = F.coalesce(agg, F.lit(0))
        out.append(agg.alias(name))
    joined = rows.select("*", *out).where("side = 1")
    return joined.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *aggs)


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides under the union of their columns; missing ones are NULL."""
    return left.unionByName(right, allowMissingColumns=True)


def plus_join(left: DataFrame, right: DataFrame, on: list[str], order: list[str] | None = None) -> DataFrame:
    """Left rows with the numeric columns that both sides have added up; left schema and types.

    Of several right rows of a key the last by ``order`` (by all its columns if not given) counts. Left rows without partner,
    and those with a null key, pass through; a NULL on the right adds nothing, a NULL on the left stays NULL.
    """
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    kinds = dict(left.dtypes)
    shared = [c for c, kind in right.dtypes if c in kinds and c not in on and kind in numeric and kinds[c] in numeric]
    last = right.groupBy(*on).agg(F.max_by(F.struct(*shared), F.struct(*(order or right.columns))).alias("add_"))
    joined = left.join(last, on, "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(f"add_.{c}"), F.lit(0))).cast(kinds[c]).alias(c) if c in shared else F.col(c) for c in left.columns])


def semi_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in the only column of another table (IN subquery)."""
    return df.join(values.toDF(column).distinct(), column, "left_semi")


def anti_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """NOT IN a subquery, with SQL's treatment of NULL: none qualifies if the values hold one, and all if there are none.

    Whether there are values and NULLs among them is asked first, in one row; what is left is an equi-join.
    """
    name = "in_" + column
    values = values.toDF(name)
    n, known = values.agg(F.count(F.lit(1)), F.count(name)).first()
    if n == 0:
        return df
    if known < n:
        return df.where(F.lit(False))
    return df.where(F.col(column).isNotNull()).join(values.distinct(), F.col(column) == F.col(name), "left_anti")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a side for broadcast if it has at most max_rows rows (which are counted), else leaves the choice to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
