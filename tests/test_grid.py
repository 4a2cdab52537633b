"""Irregular readings onto a regular grid."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators.grid import regular_grid

SCHEMA = "symbol bigint, ts timestamp_ntz, price bigint, id bigint, v string, p string"
DAY = dt.datetime(2024, 3, 4)


def brute(rows, period=300, shard=86400):
    """Every period of a symbol in a plain loop."""
    seen = {}
    for s, t, price, i, *_ in rows:
        if s is None or t is None or price is None or price <= 0:
            continue
        us = int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        p = us // (period * 10**6)
        n, best = seen.setdefault(s, {}).get(p, (0, None))
        seen[s][p] = (n + 1, max(best, (us, i, price)) if best else (us, i, price))
    out = set()
    for s, periods in seen.items():
        last = None
        for p in range(min(periods), max(periods) + 1):
            if p in periods:
                n, (_, _, last) = periods[p]
                out.add((s, p * period, last, n, "reading"))
            else:
                day = p * period // shard
                inside = any(q < p and q * period // shard == day for q in periods) and any(q > p and q * period // shard == day for q in periods)
                out.add((s, p * period, last, 0, "gap" if inside else "carried"))
    return out


def grid(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return regular_grid(df, "symbol", "ts", "price", tie="id", valid=F.col("price") > 0)


def test_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        s = rng.choice([1, 1, 1, 1, 2, 3, None])
        t = DAY + dt.timedelta(seconds=rng.choice([rng.randrange(9000), rng.randrange(86400 * 4)]), microseconds=rng.randrange(10**6))
        rows.append((s, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice([5, 7, 9, 0, -1, None]), i, "x", None))
    rows += rows[:40]
    got = {tuple(r) for r in grid(spark, rows).collect()}
    assert got == brute(rows)


def test_ties_take_the_greater_id(spark):
    t = DAY + dt.timedelta(seconds=10)
    rows = [(1, t, 5, 2, "", ""), (1, t, 9, 1, "", ""), (1, t, 5, 2, "", "")]
    assert [tuple(r) for r in grid(spark, rows).collect()] == [(1, 1709510400, 5, 3, "reading")]


def test_shards_without_readings_are_filled(spark):
    rows = [(1, DAY, 5, 1, "", ""), (1, DAY + dt.timedelta(days=3), 6, 2, "", "")]
    got = grid(spark, rows).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in got} == {"reading": 2, "carried": 3 * 288 - 1}


def test_before_the_epoch(spark):
    rows = [(1, dt.datetime(1969, 12, 31, 23, 50), 5, 1, "", ""), (1, dt.datetime(1970, 1, 1, 0, 10), 6, 2, "", "")]
    assert {tuple(r) for r in grid(spark, rows).collect()} == brute(rows)


def test_empty_and_all_null(spark):
    assert grid(spark, []).count() == 0
    assert grid(spark, [(None, None, None, None, None, None), (1, DAY, -5, 1, "", "")]).count() == 0
