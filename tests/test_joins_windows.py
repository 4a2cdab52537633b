"""Time joins and row-to-row functions against plain loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import joins as J
from tickloom.operators import windows as W

L = "k bigint, t bigint, id bigint, bid double, b string"
R = "k bigint, t bigint, q bigint, bid double, side string"


def make(rng, n, right):
    rows = []
    for i in range(n):
        k = rng.choice([1, 1, 1, 2, None])
        t = rng.choice([rng.randrange(-50, 400), rng.randrange(-50, 400), None if i % 7 == 0 else 3])
        rows.append((k, t, i, float(rng.randrange(9)) if rng.random() > 0.1 else None, "x"))
    return rows


def frames(spark, seed, n=150):
    rng = random.Random(seed)
    left, right = make(rng, n, False), make(rng, n, True)
    return left + left[:9], right, spark.createDataFrame(left + left[:9], L), spark.createDataFrame(right, R)


@pytest.mark.parametrize("bucket", [1, 17, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof(spark, bucket, how):
    left, right, ldf, rdf = frames(spark, bucket)
    want = []
    for k, t, i, *_ in left:
        mine = [(u, q) for k2, u, q, *_ in right if None not in (k, t, k2, u) and k2 == k and u <= t]
        if mine:
            want.append((i, max(mine)[1]))
        elif how == "left":
            want.append((i, None))
    out = J.asof_join(ldf, rdf, ["k"], "t", "t", how=how, tie=["q"], bucket=bucket)
    assert out.columns == ["k", "t", "id", "bid", "b", "t_right", "q", "bid_right", "side"]
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    assert sorted(((r["id"], r["q"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert J.aj0(ldf, rdf, ["k"], "t", "t", bucket=bucket).columns == ldf.columns


@pytest.mark.parametrize(("before", "after"), [(0, 0), (10, 5), (60, 0)])
def test_window_join(spark, before, after):
    left, right, ldf, rdf = frames(spark, before + 1)
    want = []
    for k, t, i, *_ in left:
        mine = [v for k2, u, _, v, _ in right if None not in (k, t, k2, u) and k2 == k and t - before <= u <= t + after and v is not None]
        want.append((i, len(mine), max(mine, default=0.0), round(sum(mine), 6)))
    out = J.window_join(ldf, rdf, ["k"], "t", "t", before, after, {"n": ("count", "bid"), "top": ("max", "bid"), "total": ("sum", "bid")})
    assert sorted((r["id"], r["n"], r["top"], round(r["total"], 6)) for r in out.collect()) == sorted(want)


def test_joins_of_empty_tables(spark):
    _, _, ldf, rdf = frames(spark, 5, 20)
    assert J.asof_join(ldf.limit(0), rdf, ["k"], "t", "t", bucket=10).count() == 0
    assert J.asof_join(ldf, rdf.limit(0), ["k"], "t", "t", bucket=10).count() == 0
    assert J.window_join(ldf, rdf.limit(0), ["k"], "t", "t", 1, 1, {"n": ("count", "bid")}).where("n = 0").count() == ldf.count()
    assert J.window_join(ldf, rdf.limit(0), ["k"], "t", "t", 1, 1, {"m": ("avg", "bid")}, empty="null").where("m is null").count() == ldf.count()


def test_plus_and_union_join(spark):
    left = spark.createDataFrame([(1, 5, 1.5, "a"), (2, None, 2.0, "b"), (None, 7, 0.0, "c"), (9, 1, 1.0, "d")], "k int, n int, x double, s string")
    right = spark.createDataFrame([(1, 10, None, 1), (1, 20, 0.5, 2), (2, 3, 4.0, 1), (None, 100, 1.0, 1)], "k int, n int, x double, turn int")
    out = {r["s"]: (r["n"], r["x"]) for r in J.plus_join(left, right, ["k"], ["turn"]).collect()}
    assert out == {"a": (25, 2.0), "b": (None, 6.0), "c": (7, 0.0), "d": (1, 1.0)}
    assert J.plus_join(left, right, ["k"]).schema == left.schema
    assert J.union_join(left, right).columns == ["k", "n", "x", "s", "turn"]


def test_not_in_with_null(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert [r[0] for r in J.anti_in(df, "x", df.where("x = 2")).orderBy("x").collect()] == [1, 3]
    assert J.anti_in(df, "x", spark.createDataFrame([(2,), (None,)], "y int")).count() == 0
    with_null = df.union(spark.createDataFrame([(None,)], "x int"))
    assert J.anti_in(with_null, "x", df.where("x = 2")).count() == 2
    assert J.anti_in(with_null, "x", df.limit(0)).count() == 4
    assert "NestedLoop" not in J.anti_in(df, "x", df.where("x = 2"))._jdf.queryExecution().toString()


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (6, 10_000), (6, 7), (40, 3)])
def test_ema_chains_over_partitions(spark, partitions, batch):
    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.choice([float(rng.randrange(100)), None] if i % 11 == 0 else [float(rng.randrange(100))])) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["k"], r["o"]): r["ema"] for r in W.ema(spark.createDataFrame(rows, "k bigint, o bigint, x double"), "k", ["o"], "x", period=9, partitions=partitions).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for k, o, x in sorted(rows):
        if x is not None:
            state[k] = 0.2 * x + 0.8 * state[k] if k in state else x
            want[k, o] = state[k]
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_ema_of_a_partition_read_in_many_pieces(spark):
    rows = spark.range(30_000).selectExpr("if(id % 5 = 0, id % 7, 99) as k", "id as o", "cast(id % 101 as double) as x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = W.ema(rows, "k", ["o"], "x", alpha=0.05, partitions=3).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = rows.toPandas().sort_values(["k", "o"])
    want["ema"] = want.groupby("k")["x"].transform(lambda x: x.ewm(alpha=0.05, adjust=False).mean())
    both = got.merge(want, on=["k", "o"])
    assert len(both) == len(got) == 30_000 and (both["ema_x"] - both["ema_y"]).abs().max() < 1e-9


def test_ema_of_nothing(spark):
    assert W.ema(spark.createDataFrame([], "k bigint, o bigint, x double"), "k", ["o"], "x").count() == 0
    with pytest.raises(ValueError, match="alpha"):
        W.ema_alpha(alpha=0.0)


def test_delta_and_ratio(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 0), (1, 3, 5), (1, 4, 10)], "k int, o int, x int")
    w = Window.partitionBy("k").orderBy("o")
    out = df.select("o", W.delta("x", w).alias("d"), W.ratio("x", w).alias("r")).orderBy("o").collect()
    assert [(r["d"], r["r"]) for r in out] == [(10, 1_000_000), (-10, 0), (5, 0), (5, 2_000_000)]


def test_window_functions_by_name(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "o int, x int")
    w = Window.partitionBy(F.lit(1)).orderBy("o")
    got = {n: [r[0] for r in df.select(W.window_function(n, "x", w)).collect()] for n in ("row_number", "sum", "lag", "lead", "delta", "count")}
    assert got == {"row_number": [1, 2, 3], "sum": [10, 30, 50], "lag": [0, 10, 20], "lead": [20, 20, 0], "delta": [10, 10, 0], "count": [1, 2, 3]}
    with pytest.raises(ValueError, match="unknown"):
        W.window_function("nope", "x", w)


def test_median_positions(spark):
    from tickloom.operators.aggs import percentile_lower, vwap

    df = spark.createDataFrame([(100,), (200,), (300,), (400,), (500,), (None,)], "x int")
    assert tuple(percentile_lower(df, [], "x", [0, 50, 90, 100]).first()) == (5, 100, 300, 400, 500)
    pv = spark.createDataFrame([(10, 1), (20, 3), (None, 5), (7, None)], "p int, v int")
    assert pv.agg(vwap("p", "v")).first()[0] == 17.5
    assert pv.where("v is null").agg(vwap("p", "v")).first()[0] is None
    assert df.agg(F.round(F.stddev_pop("x"), 3)).first()[0] == 141.421


@pytest.mark.parametrize("by", [[], ["g"]])
def test_percentiles_over_many_partitions(spark, by):
    rows = spark.range(5_000).selectExpr("if(id % 3 = 0, null, if(id % 2 = 0, 'a', 'b')) as g", "cast((id * 7919) % 1000 as double) as x").union(spark.createDataFrame([("a", None), ("z", None)], "g string, x double"))
    from tickloom.operators.aggs import percentile_lower

    got = {(r["g"] if by else 0): tuple(r)[-3:] for r in percentile_lower(rows, by, "x", [50, 95], partitions=7).collect()}
    plain = {(r["g"] if by else 0): tuple(r)[-3:] for r in percentile_lower(rows, by, "x", [50, 95]).collect()}
    pdf = rows.toPandas().dropna(subset=["x"])
    groups = pdf.groupby("g", dropna=False) if by else [(0, pdf)]
    want = {(None if k != k else k): (len(g), *(sorted(g["x"])[p * (len(g) - 1) // 100] for p in (50, 95))) for k, g in groups}
    assert got == plain == want
