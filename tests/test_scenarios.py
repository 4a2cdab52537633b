"""Statements as they are used on ticks and sensor readings; relations between results rather than single values."""

import pytest

from tickloom.sql import Engine

BASE, SEC = 1_711_000_000_000_000_000, 10**9


@pytest.fixture(scope="module")
def engine(spark):
    ticks = [(s, s * 10_000 + 10 * i, (50 if s == 3 else 100 * s) + i, BASE + i * SEC) for s in (1, 2, 3) for i in range(100)]
    sensors = [(d, 5000 + 100 * d + i + (500 if i % 50 == 0 else 0), 100 + i % 30, BASE + i * SEC // 10) for d in range(5) for i in range(200)]
    e = Engine(spark)
    e.register("trades", spark.createDataFrame(ticks, "symbol bigint, price bigint, volume bigint, timestamp bigint"))
    e.register("sensors", spark.createDataFrame(sensors, "symbol bigint, price bigint, volume bigint, timestamp bigint"))
    return e


def rows(engine, sql):
    return [r.asDict() for r in engine.sql(sql).collect()]


def test_candles(engine):
    bars = rows(engine, "SELECT xbar(timestamp, 10000000000) AS bar, first(price) AS o, max(price) AS h, min(price) AS l, last(price) AS c, sum(volume) AS v FROM trades WHERE symbol = 1 GROUP BY xbar(timestamp, 10000000000) ORDER BY bar")
    assert len(bars) == 10
    assert all(b["l"] <= b["o"] <= b["h"] and b["l"] <= b["c"] <= b["h"] and b["c"] - b["o"] == 90 for b in bars)
    assert sum(b["v"] for b in bars) == sum(100 + i for i in range(100))


def test_ranking_by_vwap(engine):
    got = rows(engine, "SELECT symbol, vwap(price, volume) AS v FROM trades GROUP BY symbol ORDER BY v DESC")
    assert [r["symbol"] for r in got] == [3, 2, 1]


def test_bars_in_stages(engine):
    sql = """WITH bars AS (SELECT symbol, xbar(timestamp, 20000000000) AS bar, max(price) - min(price) AS spread, sum(volume) AS v FROM trades GROUP BY symbol, xbar(timestamp, 20000000000)),
      busy AS (SELECT symbol, bar, v, spread FROM bars WHERE v > 3000) SELECT symbol, count(*) AS n, max(v) AS top FROM busy GROUP BY symbol ORDER BY top DESC LIMIT 2"""
    got = rows(engine, sql)
    assert got[0]["symbol"] == 2 and all(r["top"] > 3000 for r in got)


def test_averages_and_lags(engine):
    got = rows(engine, "SELECT price, EMA(price, 5) OVER (PARTITION BY symbol ORDER BY timestamp) AS e, LAG(price, 1) OVER (PARTITION BY symbol ORDER BY timestamp) AS before FROM trades WHERE symbol = 2 ORDER BY timestamp")
    assert got[0]["before"] == 0 and got[0]["e"] == got[0]["price"]
    assert all(a["price"] == b["before"] for a, b in zip(got, got[1:], strict=False))
    assert all(got[0]["price"] <= r["e"] <= r["price"] for r in got)


def test_spikes_and_dashboard(engine):
    assert rows(engine, "SELECT symbol, count(*) AS n FROM sensors WHERE price > 5000 + 100 * symbol + 400 GROUP BY symbol HAVING n > 0 ORDER BY symbol")[0] == {"symbol": 0, "n": 4}
    seconds = rows(engine, "SELECT DATE_TRUNC('s', timestamp) AS s, avg(price) AS mean, count(*) AS n FROM sensors GROUP BY DATE_TRUNC('s', timestamp) ORDER BY s")
    assert len(seconds) == 20 and all(r["n"] == 50 for r in seconds)


def test_slow_calls_and_shares(engine):
    got = rows(engine, "SELECT symbol, percentile(price, 99) AS p99, max(price) AS top, SUM(CASE WHEN volume > 125 THEN 1 ELSE 0 END) / count(*) AS share, median(price) AS mid FROM sensors GROUP BY symbol ORDER BY symbol")
    assert all(r["mid"] < r["p99"] <= r["top"] for r in got)


def test_union_and_time_range(engine):
    got = rows(engine, f"SELECT symbol, price FROM trades WHERE symbol = 1 AND timestamp BETWEEN {BASE} AND {BASE + 4 * SEC} UNION ALL SELECT symbol, price FROM trades WHERE symbol = 3 AND timestamp > {BASE + 97 * SEC} ORDER BY price DESC")
    assert [r["symbol"] for r in got] == [3, 3, 1, 1, 1, 1, 1]


def test_one_task_or_many_give_the_same(engine, spark):
    sql = "SELECT symbol, sum(price * volume) AS n, stddev(price) AS s, count(DISTINCT volume) AS d FROM trades GROUP BY symbol ORDER BY symbol"
    many = rows(engine, sql)
    one = Engine(spark).register("trades", engine.table("trades").coalesce(1))
    assert [r["n"] for r in rows(one, sql)] == [r["n"] for r in many] and rows(one, sql)[0]["d"] == many[0]["d"]
