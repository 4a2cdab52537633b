"""Percentiles by radix selection."""

import math
import random
import struct

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import radix

SCHEMA = "g string, h int, x double, n string, p50 string"


def bits(x):
    b = struct.unpack("q", struct.pack("d", abs(x)))[0]
    return -b if x < 0 else b


def brute(rows, percents):
    groups = {}
    for g, h, x, *_ in rows:
        if g is not None and h is not None and x is not None and math.isfinite(x):
            groups.setdefault((g, h), []).append(x)
    return {(*k, len(v), *(sorted(v)[p * (len(v) - 1) // 100] for p in percents)) for k, v in groups.items()}


def test_integers_are_the_bits(spark):
    edge = [0.0, -0.0, 5e-324, 2.0**-1022, 2.225073858507201e-308, 1.7976931348623157e308, math.nextafter(2.0**1000, 0), 2.0**1000, 2.0**-900]
    values = edge + [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, math.inf) for e in range(-1070, 1023, 11)]
    rng = random.Random(1)
    values += [x for _ in range(5000) if math.isfinite(x := struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0])]
    values += [-x for x in values]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    out = radix.with_ordered_int(df, "x", ["i"], "c").select("i", "c", radix.value_of(F.col("c")).alias("back")).collect()
    assert len(out) == len(values)
    assert all(r["c"] == bits(values[r["i"]]) and r["back"] == values[r["i"]] for r in out)


def test_against_sorting(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        x = rng.choice([rng.gauss(100, 30), rng.choice([1.5, 1.5, -2.0, 0.0, -0.0, 1e308, -1e308, 5e-324, None, math.nan, math.inf, -math.inf])])
        rows.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]) if i % 5 == 0 else 1, x, "", None))
    rows += [("one", 1, 7.0, "", ""), ("none", 1, None, "", ""), ("same", 1, 3.0, "", ""), ("same", 1, 3.0, "", "")]
    got = radix.percentiles(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "x", [0, 50, 95, 100])
    assert got.columns == ["g", "h", "n", "p0", "p50", "p95", "p100"]
    assert {tuple(r) for r in got.collect()} == brute(rows, [0, 50, 95, 100])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    rows = [("a", 1, x, "", "") for x in values]
    got = radix.percentiles(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "x", [37])
    assert {tuple(r) for r in got.collect()} == brute(rows, [37])


def test_merged_days_enclose_the_exact_value(spark):
    rng = random.Random(3)
    rows = [("a", d % 3, rng.lognormvariate(3, 2) * rng.choice([1, -1]), "", "") for d in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [radix.histogram(df.where(f"h = {d}"), ["g"], "x") for d in range(3)]
    merged = radix.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    r = radix.percentiles_of(merged, ["g"], [5, 50, 95]).first()
    values = sorted(x for _, _, x, *_ in rows)
    for p in (5, 50, 95):
        exact, lo, hi = values[p * (len(values) - 1) // 100], r[f"p{p}_lo"], r[f"p{p}_hi"]
        assert lo <= exact <= hi and abs(hi - lo) <= abs(exact) * 2**-7
    assert r["n"] == 3000


def test_ranks_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(radix, "MAX_BROADCAST_GROUPS", 0)
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), 1, round(rng.gauss(5, 3), 1), "", "") for _ in range(800)]
    got = radix.percentiles(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "x", [50, 95])
    assert {tuple(r) for r in got.collect()} == brute(rows, [50, 95])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert radix.percentiles(df, ["g", "h"], "x", [50]).count() == 0
    assert radix.percentiles_of(radix.histogram(df, ["g"], "x"), ["g"], [50]).count() == 0


def test_a_million_values_share_their_leading_bits(spark):
    df = spark.range(1_000_000).selectExpr("1 as g", "cast(1000 + id * 1e-10 as double) as x")
    (row,) = radix.percentiles(df, ["g"], "x", [50, 95]).collect()
    want = sorted({1000 + i * 1e-10 for i in (499_999, 949_999)})
    assert (row["n"], [row["p50"], row["p95"]]) == (1_000_000, want)
    assert max(radix.DIGIT_BITS) <= 16
