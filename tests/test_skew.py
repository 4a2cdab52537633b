"""Per-key sequences by exact offset chunking."""

import datetime as dt
import random

import pytest

from tickloom.operators.skew import numbered, unusual_values

SCHEMA = "symbol bigint, ts timestamp_ntz, id bigint, volume bigint, k string, rn string"
DAY = dt.datetime(2024, 3, 4)


def brute(rows, before=20, factor=10):
    once = {}
    for s, t, i, v, *_ in rows:
        if s is not None and t is not None and i is not None and v is not None and v > 0:
            once[s, t, i] = min(v, once.get((s, t, i), v))
    keys = {}
    for (s, t, i), v in sorted(once.items()):
        keys.setdefault(s, []).append((i, v))
    out = set()
    for s, seq in keys.items():
        for n in range(before, len(seq)):
            total = sum(v for _, v in seq[n - before : n])
            if seq[n][1] * before >= factor * total:
                out.add((s, seq[n][0], n + 1, seq[n][1], total))
    return out


def make(rng, n, hot=0.8):
    rows = []
    for i in range(n):
        s = 7 if rng.random() < hot else rng.choice([1, 2, 3, None])
        v = rng.choice([100, 110, 90, 1200, 2500]) if rng.random() < 0.2 else rng.choice([100, 101, 0, -4, None])
        rows.append((s, DAY + dt.timedelta(seconds=rng.randrange(n // 3)), i, v, "a", None))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("chunk", "partitions"), [(20, 7), (64, 3), (100_000, 1), (33, 16)])
def test_against_a_plain_loop(spark, chunk, partitions):
    rows = make(random.Random(chunk), 2500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = unusual_values(df, "symbol", "ts", "id", "volume", chunk_rows=chunk, partitions=partitions)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))


def test_offsets_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("tickloom.operators.skew.MAX_BROADCAST_OFFSETS", 0)
    rows = make(random.Random(8), 1500)
    got = unusual_values(spark.createDataFrame(rows, SCHEMA), "symbol", "ts", "id", "volume", chunk_rows=64, partitions=6)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_small_batches(spark):
    rows = make(random.Random(3), 1200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = unusual_values(spark.createDataFrame(rows, SCHEMA), "symbol", "ts", "id", "volume", chunk_rows=50, partitions=5)
        assert {tuple(r) for r in got.collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers_are_exact(spark):
    rows = make(random.Random(9), 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = numbered(df.where("ts is not null"), "symbol", ["ts", "id"], [], 9).collect()
    want = {}
    for s, t, i in sorted({(s, t, i) for s, t, i, *_ in rows if s is not None}):
        want.setdefault(s, []).append((t, i))
    assert {(r["k"], r["o0"], r["o1"], r["rn"]) for r in got} == {(s, t, i, n + 1) for s, seq in want.items() for n, (t, i) in enumerate(seq)}
    assert len(got) == sum(map(len, want.values()))


def test_a_third_of_all_rows_is_one_trade(spark):
    rows = make(random.Random(12), 600)
    rows += [rows[5]] * 400
    got = unusual_values(spark.createDataFrame(rows, SCHEMA).repartition(5), "symbol", "ts", "id", "volume", partitions=5)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_text_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 4)], "k string, o bigint")
    assert {(r["k"], r["rn"]) for r in numbered(df, "k", ["o"], []).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert numbered(df.limit(0), "k", ["o"], []).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert unusual_values(empty, "symbol", "ts", "id", "volume").count() == 0


def test_chunks_are_row_groups_of_equal_size(spark):
    import glob

    import pyarrow.parquet as pq

    from tickloom.operators.skew import placed

    rows = spark.range(10_000).selectExpr("id % 3 as k", "id as o", "id as v")
    got = placed(rows, "k", ["o"], ["v"], partitions=2, chunk_rows=500)
    files = [f for path in got.inputFiles() for f in glob.glob(path.removeprefix("file://"))]
    sizes = [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in (pq.ParquetFile(f).metadata for f in files)]
    assert all(n == 500 for groups in sizes for n in groups[:-1]) and max(map(len, sizes)) > 5
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a partition is read by several tasks
    try:
        assert numbered(rows, "k", ["o"], ["v"], partitions=2, chunk_rows=500).where("rn <> o0 div 3 + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_partitions_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr("tickloom.storage.PARTITION_BYTES", 1000)
    from tickloom.storage import partitions_for

    assert partitions_for(spark.range(10_000)) == 80
    assert partitions_for(spark.range(10_000), 3) == 3
