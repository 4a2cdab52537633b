"""Late and out-of-order events."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.functions.time import nanos_of
from tickloom.operators import late

S = 10**9


def brute(events, period=300 * S, lateness=900 * S, publish=60 * S):
    status, versions = set(), {}
    for i, e, a in events:
        end = (e // period + 1) * period
        s = "on_time" if a < end else "corrected" if a <= end + lateness else "too_late"
        status.add((i, e, a, end - period, s))
        if s != "too_late":
            at = end if a < end else (a // publish + 1) * publish
            versions.setdefault(end - period, {}).setdefault(at, 0)
            versions[end - period][at] += 1
    out = set()
    for p, published in versions.items():
        n = 0
        for k, at in enumerate(sorted(published)):
            n += published[at]
            out.add((p // S, at // S, n, k + 1))
    return status, out


def make(n, seed):
    rng = random.Random(seed)
    base = 1_709_510_400 * S
    rows = []
    for i in range(n):
        e = base + rng.randrange(86_400 * 2) * S + rng.randrange(S)
        lag = rng.choice([rng.randrange(4), rng.randrange(1500), rng.randrange(9000)]) * S + rng.randrange(S)
        if i % 10 == 0:  # exactly at the limits
            end = (e // (300 * S) + 1) * 300 * S
            lag = rng.choice([end - e, end + 900 * S - e, end + 900 * S - e + 1, end - e - 1])
        rows.append((f"q{i}", e, e + lag))
    return rows


def test_against_plain_rules(spark):
    rows = make(1500, 1)
    df = spark.createDataFrame(rows, "id string, e bigint, a bigint")
    status, versions = brute(rows)
    for part_rows in (50_000, 100):  # one part a shard, and salted ones
        got = late.event_status(df, "id", "e", "a", part_rows=part_rows, every=16)
        assert {tuple(r) for r in got.collect()} == status
        got = late.corrected_counts(df, "id", "e", "a", part_rows=part_rows, every=16)
        assert {tuple(r) for r in got.collect()} == versions


def test_first_arrival_counts(spark):
    df = spark.createDataFrame([("a", 5, 9), ("a", 3, 8), ("a", 4, 8), ("b", None, 1), ("c", 1, None), (None, 1, 2), (None, 1, 2)], "id string, e bigint, a bigint")
    got = sorted(tuple(r) for r in late.first_arrivals(df, "id", "e", "a").collect() if r["id"])
    assert got == [("a", 3, 8)]
    assert late.first_arrivals(df, "id", "e", "a").where("id is null").count() == 2


def test_units(spark):
    ns = 1_709_510_443_385_235_611
    values = [ns, ns // 10**3, ns // 10**6, ns // 10**9, None, 17]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r[0] for r in df.select(nanos_of(df["v"])).collect()]
    assert got == [ns, ns // 10**3 * 10**3, ns // 10**6 * 10**6, ns // 10**9 * 10**9, None, None]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, e bigint, a bigint")
    assert late.event_status(df, "id", "e", "a").count() == 0
    assert late.corrected_counts(df, "id", "e", "a").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), min_size=1, max_size=12), max_size=20), st.integers(1, 9))
def test_replay_equals_recount(batches, every):
    state = late.Replay(50, every)
    counts = {}
    for batch in batches:
        changed = state.arrive(np.array(batch, np.int64))
        for t in batch:
            counts[t // 50] = counts.get(t // 50, 0) + 1
        assert state.outputs == counts
        assert set(changed) == {t // 50 for t in batch}
        assert state.times.tolist() == sorted(state.times.tolist())


def test_replay_starts_at_a_checkpoint():
    state = late.Replay(1000, 10)
    state.arrive(np.arange(0, 100_000, 10, dtype=np.int64))
    before = state.replayed
    state.arrive(np.array([99_001]))
    assert state.replayed - before < 130


def test_status_comes_from_the_replay(monkeypatch):
    pdf = pd.DataFrame({"id": ["a", "b", "c"], "event": [10 * S, 20 * S, 30 * S], "arrival": [70 * S, 310 * S, 9000 * S]})
    args = (300 * S, 900 * S, 60 * S, 16, True)
    assert late._replay_part(pdf, *args)["status"].tolist() == ["on_time", "corrected", "too_late"]
    monkeypatch.setattr(late.Replay, "arrive", lambda self, times: {})
    with pytest.raises((KeyError, AssertionError)):
        late._replay_part(pdf, *args)


def test_a_slot_in_which_a_period_ends():
    pdf = pd.DataFrame({"id": ["a", "b"], "event": [10 * S, 20 * S], "arrival": [70 * S, 100 * S]})
    got = late._replay_part(pdf, 90 * S, 900 * S, 60 * S, 16, False)
    assert sorted(zip(got["published_ns"], got["change"], strict=True)) == [(90 * S, 1), (120 * S, 1)]
