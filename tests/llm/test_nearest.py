"""Nearest records in time by x-fast tries."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import nearest
from tickloom.llm.nearest import XFastTries, nearest_in_time

EPOCH = dt.datetime(1970, 1, 1)
L_SCHEMA = "symbol bigint, ts timestamp_ntz, q bigint, gap_us string, entity string"
R_SCHEMA = "symbol bigint, ts timestamp_ntz, t bigint, gap_us string, block string"


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(left, right, tolerance):
    out = set()
    for s, t, q, *_ in left:
        if None in (s, t, q):
            continue
        best = min(((abs(us(u) - us(t)), us(u), i) for s2, u, i, *_ in right if None not in (s2, u, i) and s2 == s), default=None)
        if best and best[0] <= tolerance:
            out.add((q, best[2], best[1] - us(t)))
    return out


def run(spark, left, right, tolerance, **options):
    out = nearest_in_time(spark.createDataFrame(left, L_SCHEMA), spark.createDataFrame(right, R_SCHEMA), "symbol", "ts", "q", "t", tolerance_us=tolerance, **options)
    assert out.columns == ["q", "t", "gap_us"]
    return out


def make(rng, n, start, span):
    times = [start + dt.timedelta(microseconds=rng.randrange(span)) for _ in range(n)]
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([t, t, t, t, None]), i if rng.random() > 0.03 else None, "", "") for i, t in enumerate(times)]


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    for start, tolerance, batch in ((dt.datetime(2024, 3, 4), 500_000, 200_000), (dt.datetime(1969, 12, 31, 23, 59, 50), 1000, 64), (dt.datetime(2024, 3, 4), 0, 7)):
        monkeypatch.setattr(nearest, "BATCH_ROWS", batch)
        span = max(200, tolerance * 40)
        left, right = make(rng, 250, start, span), make(rng, 300, start, span)
        right += right[:20]
        left += left[:20]
        got = run(spark, left, right, tolerance, partitions=3).collect()
        assert {tuple(r) for r in got} == brute(left, right, tolerance)
        assert len(got) == len(brute(left, right, tolerance))


def test_ties(spark):
    t = dt.datetime(2024, 3, 4)
    ms = dt.timedelta(milliseconds=1)
    left = [(1, t, 1, "", "")]
    right = [(1, t + 5 * ms, 1, "", ""), (1, t - 5 * ms, 9, "", ""), (1, t - 5 * ms, 8, "", "")]
    assert [tuple(r) for r in run(spark, left, right, 5000).collect()] == [(1, 8, -5000)]
    assert run(spark, left, right, 4999).count() == 0


def test_one_instant_holds_everything(spark):
    t = dt.datetime(2024, 3, 4)
    left = [(1, t, i, "", "") for i in range(300)]
    right = [(1, t, i + 5, "", "") for i in range(300)]
    assert {tuple(r) for r in run(spark, left, right, 10).collect()} == {(i, 5, 0) for i in range(300)}


def test_empty(spark):
    row = [(1, dt.datetime(2024, 3, 4), 1, "", "")]
    assert run(spark, [], row, 10).count() == 0
    assert run(spark, row, [], 10).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.sets(st.tuples(st.integers(0, 2), st.integers(0, 63)), max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63)), max_size=30))
def test_neighbours(bits, leaves, queries):
    size = 1 << bits
    a = np.array(sorted({(t << bits) + x % size for t, x in leaves}), np.int64)
    q = np.array([(t << bits) + x % size for t, x in queries], np.int64)
    before, after = XFastTries(a, bits).neighbours(q)
    for x, b, f in zip(q.tolist(), before.tolist(), after.tolist(), strict=True):
        mine = [v for v in a.tolist() if v >> bits == x >> bits]
        assert (a[b] if b >= 0 else None) == max((v for v in mine if v <= x), default=None)
        assert (a[f] if f >= 0 else None) == min((v for v in mine if v >= x), default=None)


@pytest.mark.parametrize(("bits", "batch"), [(22, 200_000), (3, 200_000), (5, 9)])
def test_tolerances_over_many_subtrees(spark, monkeypatch, bits, batch):
    """An entity's neighbours are found over empty subtrees, whatever the tolerance."""
    monkeypatch.setattr(nearest, "MAX_BITS", bits)
    monkeypatch.setattr(nearest, "STRETCH_BITS", 4)
    monkeypatch.setattr(nearest, "BATCH_ROWS", batch)
    rng = random.Random(bits)
    start, span = dt.datetime(2024, 3, 4), 20_000 if bits < 22 else 3 * 86_400_000_000
    left, right = make(rng, 200, start, span), make(rng, 60, start, span)
    for tolerance in (span // 50, 86_400_000_000):
        got = [tuple(r) for r in run(spark, left, right, tolerance, partitions=3).collect()]
        assert set(got) == brute(left, right, tolerance) and len(got) == len(set(got))
