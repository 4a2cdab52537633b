"""Messages delivered more than once."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import dedup
from tickloom.operators.dedup import SeenRanges, _accept, _accept_unsorted, deduplicate, message_rows

SCHEMA = "row bigint, node bigint, eid string, seq bigint, dup string, series string, block string"
ARGS = ("row", "node", "eid", "seq")


def brute(rows):
    norm = lambda e: (e.strip(" \t").lower() or None) if e is not None else None
    owner = {}
    for r, n, e, s, *_ in sorted(rows, key=lambda x: x[0]):
        if n is not None and norm(e) and s is not None:
            owner.setdefault((n, s), norm(e))
    seen, dups = set(), set()
    for r, n, e, s, *_ in sorted(rows, key=lambda x: x[0]):
        key = norm(e) or (owner.get((n, s)) if s is not None else None)
        k = (n, "id", key) if key else (n, "seq", s) if s is not None else None
        if n is None or k is None:
            continue
        if k in seen:
            dups.add(r)
        seen.add(k)
    return dups


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for r in range(n):
        node = rng.choice([1, 1, 1, 1, 2, 3, None] if r % 9 == 0 else [1, 1, 1, 2])
        m = rng.randrange(n // 2)
        form = rng.choice([f"q00-{m:07d}|decision", f"q00-{m:07d}|retrieval|{m % 3}", f"e00.{m}|decision", f"Q00-{m:07d}|Decision", f" q00-{m:07d}|decision\t", f"free text {'x' * (m % 7)}", "", "  ", None, f"{m}", f"{m:03d}", "999999999999999999999999"])
        rows.append((r, node, form, rng.choice([m, m, None]), "a", "b", None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_against_a_plain_loop(spark, parts):
    rows = make(3000, parts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if parts == 1:
        df = df.orderBy("row").coalesce(1)
    got = message_rows(df, *ARGS)
    assert {r["row"] for r in got.where("dup").collect()} == brute(rows)
    assert got.count() == len(rows)


def test_kept_rows_are_whole(spark):
    rows = make(400, 3)
    kept = deduplicate(spark.createDataFrame(rows, SCHEMA), *ARGS).collect()
    assert {tuple(r) for r in kept} == {r for r in rows if r[0] not in brute(rows)}


def test_a_third_of_all_rows_is_one_message(spark):
    rows = [(r, 1, "q00-0000001|decision" if r % 3 == 0 else f"q00-{r:07d}|decision", None, "", "", "") for r in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert {r["row"] for r in message_rows(df, *ARGS).where("dup").collect()} == brute(rows)


def test_numbers_written_apart_are_messages_apart(spark):
    rows = [(1, 1, "a7", None, "", "", ""), (2, 1, "a07", None, "", "", ""), (3, 1, "A7 ", None, "", "", ""), (4, 2, "a7", None, "", "", "")]
    assert {r["row"] for r in message_rows(spark.createDataFrame(rows, SCHEMA), *ARGS).where("dup").collect()} == {3}


def test_empty(spark):
    assert message_rows(spark.createDataFrame([], SCHEMA), *ARGS).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=15), max_size=12))
def test_ranges(batches):
    ranges, seen = SeenRanges(), set()
    for batch in batches:
        numbers = np.unique(np.array(batch, np.int64))
        covered = ranges.covers(numbers)
        assert covered.tolist() == [int(x) in seen for x in numbers]
        if (~covered).any():
            ranges.add(numbers[~covered])
        seen.update(numbers.tolist())
        assert (ranges.lo < ranges.hi).all() and (ranges.hi[:-1] < ranges.lo[1:]).all()
        assert int((ranges.hi - ranges.lo).sum()) == len(seen)


def test_batches_out_of_order_are_not_marked():
    names = ["row", "node", "series", "number", "block", "dup"]
    make_batch = lambda row: pa.RecordBatch.from_arrays([pa.array([row]), pa.array(["1"]), pa.array(["#"]), pa.array([5]), pa.array([0]), pa.array([False])], names=names)
    assert [b.column("dup").to_pylist() for b in _accept_unsorted(iter([make_batch(9), make_batch(4), make_batch(12)]))] == [[False], [False], [True]]


def batches_of(numbers, size=10_000):
    n = len(numbers)
    rows = pa.table({"row": np.arange(n), "node": ["1"] * n, "series": ["="] * n, "number": numbers, "block": numbers >> 16, "dup": np.zeros(n, bool)})
    return iter(rows.to_batches(size))


def test_isolated_numbers_take_time_in_proportion():
    def took(n):
        began = time.perf_counter()
        assert sum(b.num_rows for b in _accept(batches_of(np.arange(n) * 3))) == n
        return time.perf_counter() - began

    took(50_000)
    assert took(1_600_000) < 8 * took(400_000)  # 16 times if quadratic


def test_a_block_goes_on_in_the_next_batch():
    numbers = np.sort(np.concatenate([np.arange(5_000), np.arange(5_000)]) // 3)
    table = pa.Table.from_batches(list(_accept(batches_of(numbers, 700))))
    kept = table.filter(pa.array(~table.column("dup").to_numpy())).column("number").to_numpy()
    assert kept.tolist() == np.unique(numbers).tolist()


@pytest.mark.parametrize("few", [0, 200_000])
def test_keys_with_most_rows(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "MAX_BROADCAST_KEYS", few)
    odd = [(r, 1, "odd" if r % 10 else f"odd {'x' * (r % 90)}", None, "", "", "") for r in range(2000)]
    lacking = [(r, 2, None if r % 10 else f"q-{r}", 7 if r % 10 or r == 2000 else r, "", "", "") for r in range(2000, 4000)]
    rows = odd + lacking
    got = message_rows(spark.createDataFrame(rows, SCHEMA).repartition(4), *ARGS)
    assert {r["row"] for r in got.where("dup").collect()} == brute(rows)
    assert got.count() == len(rows)


def test_identifiers_that_are_no_utf8(spark):
    rows = [(i, 1, None, i % 4, "", "", "") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("eid", F.expr("concat(cast(X'FF41' AS string), cast(seq AS string))"))
    assert {r["row"] for r in message_rows(df, *ARGS).where("dup").collect()} == set(range(4, 12))
