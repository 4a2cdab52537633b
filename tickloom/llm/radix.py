"""Exact and mergeable percentiles of very large numeric columns, by radix selection.

A floating value is mapped to an order-preserving integer (the bits of its magnitude, negated for negative
values), computed inside generated code. Per group a histogram of the leading 16 bits (sign, exponent and the first
mantissa bits) is built with map-side combining; it tells the digit that holds each target rank. Only values with that
digit are followed: the next 16 bits are counted among them, and so on to the last, so that no histogram has more than
2**16 bins for each digit followed.

Histograms of the leading bits of separate partitions, days or files add up, which makes them mergeable
summaries: see histogram, merge and percentiles_of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.storage import materialize

#: Bits of the digits, from the most significant: a histogram, ranked in one task for each digit followed, has 2 to this power bins.
DIGIT_BITS = (16, 16, 16, 16)
#: Ranks to be followed are broadcast up to this many groups; beyond it they are joined by shuffle.
MAX_BROADCAST_GROUPS = 100_000


def with_ordered_int(df: DataFrame, value: str, keep: Sequence[str], name: str) -> DataFrame:
    """The ``keep`` columns and, as ``name``, an order-preserving integer of each finite value: its IEEE bits, negated below 0.

    Rows whose value is NULL, NaN or infinite are dropped. The exponent comes from a logarithm, put right by
    comparison with the power of two; scaling by a power of two is exact, so the mantissa is too. Both zeros
    give 0. Each step is a projection of its own, so that no step is computed more than once a row.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(1.7976931348623157e308))).select(*keep, x.alias("x_"))
    m = F.abs("x_")
    # values near the ends of the range are scaled first, so that neither a power nor a quotient over- or underflows
    high, low = m >= F.lit(2.0**1000), m < F.lit(2.0**-900)
    step = rows.select(
        *keep, "x_", F.when(high, m * F.lit(2.0**-600)).when(low, m * F.lit(2.0**600)).otherwise(m).alias("y_"),
        F.when(high, F.lit(1623)).when(low, F.lit(423)).otherwise(F.lit(1023)).cast("bigint").alias("bias_"),
    )
    step = step.select("*", F.floor(F.log2("y_")).alias("e_"))
    step = step.select("*", F.pow(F.lit(2.0), F.col("e_")).alias("p_"))
    y, p = F.col("y_"), F.col("p_")
    off = F.when(y >= p * 2, F.lit(1)).when(y < p, F.lit(-1)).otherwise(F.lit(0))
    scale = F.when(y >= p * 2, F.lit(0.5)).when(y < p, F.lit(2.0)).otherwise(F.lit(1.0))
    step = step.select(*keep, "x_", (F.col("e_") + off + F.col("bias_")).alias("e_"), (y / p * scale - 1).alias("f_"))
    tiny = (F.abs("x_") * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    normal = F.col("e_") * F.lit(1 << 52) + (F.col("f_") * F.lit(2.0**52)).cast("bigint")
    magnitude = F.when(F.col("e_") > 0, normal).otherwise(tiny)
    step = step.select(*keep, "x_", F.when(F.col("x_") == 0, F.lit(0).cast("bigint")).otherwise(magnitude).alias("c_"))
    return step.select(*keep, F.when(F.col("x_") < 0, -F.col("c_")).otherwise(F.col("c_")).alias(name))


def value_of(code: Column) -> Column:
    """The double whose ordered integer is the code."""
    c = F.abs(code)
    e, mantissa = F.shiftright(c, 52), c.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    half = (e - F.lit(1023)) / F.lit(2.0)
    low = F.floor(half)
    scaled = (F.lit(1.0) + mantissa * F.lit(2.0**-52)) * F.pow(F.lit(2.0), low) * F.pow(F.lit(2.0), (e - F.lit(1023)) - low)
    m = F.when(e == 0, mantissa * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise(scaled)
    return F.when(code < 0, -m).otherwise(m)


def histogram(df: DataFrame, by: Sequence[str], value: str, bits: int = 20) -> DataFrame:
    """Mergeable summary: per group the counts of the values' leading ``bits`` bits.

    The bits behind sign and exponent (12) are mantissa bits, so a percentile read from it lies within a factor of
    1 + 2**(12 - bits) of the exact one. NULL, NaN and infinite values and rows with a null group column
    don't count. Columns: the group columns, ``digit``, ``n``.
    """
    rows = with_ordered_int(df.where(_grouped(by)), value, list(by), "code").select(*by, F.shiftright("code", 64 - bits).alias("digit"))
    return rows.groupBy(*by, "digit").agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds up summaries of histogram (of days, files or partitions)."""
    return summaries.groupBy(*by, "digit").agg(F.sum("n").alias("n"))


def percentiles_of(summary: DataFrame, by: Sequence[str], percents: Sequence[int], bits: int = 20) -> DataFrame:
    """Percentiles read from a merged summary: ``p<percent>_lo`` and ``p<percent>_hi`` enclose the exact one."""
    along = Window.partitionBy(*by).orderBy("digit")
    seen = summary.select(*by, "digit", "n", F.sum("n").over(along).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    out = []
    for p in percents:
        rank = F.call_function("div", F.lit(p) * (F.col("total") - 1), F.lit(100).cast("bigint"))
        digit = F.min(F.when(F.col("upto") > rank, F.col("digit")))
        # a digit of negative values holds those down to its lower end as well
        out += [value_of(F.shiftleft(digit, 64 - bits)).alias(f"p{p}_lo"), value_of(F.shiftleft(digit + 1, 64 - bits) - 1).alias(f"p{p}_hi")]
    return seen.groupBy(*by).agg(F.max("total").alias("n"), *out)


def _grouped(by: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in by:
        ok = ok & F.col(c).isNotNull()
    return ok


def percentiles(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Exact percentiles per group: of n values the one at position floor(p * (n - 1) / 100), from 0, ascending.

    NULL, NaN and infinite values and rows with a null group column don't count; a group without any other value has
    no row; ties and repeated rows count as often as they occur; empty input gives no rows. Group columns may
    have any name but ``code``, ``prefix``, ``target``, ``rank``, ``digit`` and those ending in an underscore. Columns: the group columns, ``n`` and
    one double ``p<percent>`` each.
    """
    by, percents = list(by), sorted(set(percents))
    rows = materialize(with_ordered_int(df.where(_grouped(by)), value, by, "code"), "codes")
    targets, followed = None, rows
    for level, bits in enumerate(DIGIT_BITS):
        shift = 64 - sum(DIGIT_BITS[: level + 1])
        digit = F.shiftright("code", shift) if level == 0 else F.shiftright("code", shift).bitwiseAND(F.lit((1 << bits) - 1))
        if level == 0:
            counts = followed.groupBy(*by, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            total = F.sum("n").over(Window.partitionBy(*by))
            along = Window.partitionBy(*by).orderBy("digit")
            counts = counts.select(*by, "digit", "n", F.sum("n").over(along).alias("upto"), total.alias("total"))
            wanted = counts.select(
                "*", F.explode(F.array(*(F.struct(F.lit(p).alias("target"), F.call_function("div", F.lit(p) * (F.col("total") - 1), F.lit(100).cast("bigint")).alias("rank")) for p in percents))).alias("t")
            ).select(*by, "digit", "n", "upto", "total", "t.target", "t.rank")
        else:
            counts = followed.groupBy(*by, "prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            along = Window.partitionBy(*by, "prefix").orderBy("digit")
            counts = counts.select(*by, "prefix", "digit", "n", F.sum("n").over(along).alias("upto"))
            wanted = counts.join(targets, [*by, "prefix"])
        chosen = wanted.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        prefix = F.col("digit") if level == 0 else F.shiftleft("prefix", bits).bitwiseOR(F.col("digit"))
        targets = materialize(
            chosen.select(*by, "total", "target", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), prefix.alias("prefix")),
            "targets",
        )
        if shift:
            heads = targets.select(*by, "prefix").distinct()
            if targets.count() <= MAX_BROADCAST_GROUPS * len(percents):
                heads = F.broadcast(heads)
            source = followed if level == 0 else followed.drop("prefix")
            followed = materialize(
                source.withColumn("prefix", F.shiftright("code", shift)).join(heads, [*by, "prefix"], "left_semi"), "followed"
            )
    found = targets.withColumn("value", value_of(F.col("prefix")))
    return found.groupBy(*by).agg(
        F.max("total").alias("n"), *(F.max(F.when(F.col("target") == p, F.col("value"))).alias(f"p{p}") for p in percents)
    )
