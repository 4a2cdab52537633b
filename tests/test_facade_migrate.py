"""The pipeline class, the lazy interface and the translations."""

import pytest

from tickloom.facade import Lazy, Pipeline
from tickloom.migrate import ddl
from tickloom.migrate.q import QError, translate
from tickloom.sql import Engine


@pytest.fixture
def pipe(spark):
    p = Pipeline(spark)
    for i in range(10):
        p.ingest(1, 15000 + 10 * i, 100 + i, 1000 + i)
    p.ingest_batch([2] * 5, [20000 + 10 * i for i in range(5)], [200 + i for i in range(5)], [1000 + i for i in range(5)])
    return p


def test_pipeline(pipe, spark):
    assert pipe.drain() == 15 and pipe.drain() == 0
    assert (pipe.count(), pipe.count(1), pipe.count(1, 1003, 1005)) == (15, 10, 3)
    assert pipe.vwap(2) == pytest.approx(sum((20000 + 10 * i) * (200 + i) for i in range(5)) / 1010)
    assert pipe.vwap(9) is None
    assert pipe.filter_sum(1, "volume", 105) == 106 + 107 + 108 + 109
    assert pipe.get_column(2, "price").tolist() == [20000, 20010, 20020, 20030, 20040]
    assert [r["open"] for r in pipe.xbar(1, 5).orderBy("bar").collect()] == [15000, 15050]
    assert pipe.ema(2, "price", 3).orderBy("timestamp").collect()[1]["ema"] == 20005
    assert [r["delta"] for r in pipe.delta(2, "volume").orderBy("timestamp").collect()] == [200, 1, 1, 1, 1]
    assert pipe.ratio(2, "volume").orderBy("timestamp").first()["ratio"] == 1_000_000
    assert pipe.window_agg(2, "sum", "volume", 1).orderBy("timestamp").collect()[1]["sum"] == 401
    assert pipe.execute("SELECT count(*) AS n FROM trades WHERE symbol = 1").first()[0] == 10
    pipe.ingest_frame(spark.createDataFrame([(3, 1, 1, 1)], "symbol int, price int, volume int, timestamp bigint"))
    assert pipe.stats() == {"rows": 16, "symbols": 3, "batches": 2}


def test_lazy(pipe):
    df = Lazy(pipe.ticks())
    assert df[df["price"] > 20010]["volume"].sum().value == 202 + 203 + 204
    assert df[(df["symbol"] == 1) & (df["price"] <= 15010)].count().collect() == 2
    assert df.filter("symbol = 2")["price"].max().value == 20040
    assert sorted(df.filter("symbol = 2")["volume"].collect().tolist()) == [200, 201, 202, 203, 204]


Q = {
    "select from trades": "SELECT * FROM trades",
    "select price, volume from trades where symbol=1": "SELECT price, volume FROM trades WHERE (symbol = 1)",
    "select vwap: volume wavg price by symbol from trades": "SELECT symbol, VWAP(price, volume) AS vwap FROM trades GROUP BY symbol",
    "select o: first price, h: max price by bar: 5 xbar timestamp from trades where symbol=1": "SELECT XBAR(timestamp, 5) AS bar, FIRST(price) AS o, MAX(price) AS h FROM trades WHERE (symbol = 1) GROUP BY XBAR(timestamp, 5)",
    "select from trades where price within (15000;15020), volume > 100": "SELECT * FROM trades WHERE price BETWEEN 15000 AND 15020 AND (volume > 100)",
    "aj[`symbol`timestamp; trades; quotes]": "SELECT * FROM trades l ASOF JOIN quotes r ON l.symbol = r.symbol AND l.timestamp >= r.timestamp",
    "delete from trades where price<0": "DELETE FROM trades WHERE (price < 0)",
    "update price: price*2 from trades where symbol=1": "UPDATE trades SET price = (price * 2) WHERE (symbol = 1)",
    "select m: 3 mavg price from trades": "SELECT AVG(price) OVER (PARTITION BY symbol ORDER BY timestamp ROWS 2 PRECEDING) AS m FROM trades",
    "exec max price from trades": "SELECT MAX(price) AS price FROM trades",
    "select n: count i by symbol from trades": "SELECT symbol, COUNT(*) AS n FROM trades GROUP BY symbol",
    "select p: prev price from trades": "SELECT LAG(price, 1, NULL) OVER (PARTITION BY symbol ORDER BY timestamp) AS p FROM trades",
    "wj[-5 7; `symbol`timestamp; trades; (quotes; (max;`ask); (min;`bid))]": "SELECT *, wj_max(r.ask) AS ask_max, wj_min(r.bid) AS bid_min FROM trades l WINDOW JOIN quotes r ON l.symbol = r.symbol AND r.timestamp BETWEEN l.timestamp - 5 AND l.timestamp + 7",
    "select from trades where price = (max;price) fby symbol, volume > 3": "SELECT * FROM (SELECT *, MAX(price) OVER (PARTITION BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fby_0 FROM trades) AS x WHERE (price = fby_0) AND (volume > 3)",
    "select from trades where sym in `A`B": "SELECT * FROM trades WHERE sym IN ('A', 'B')",
}


@pytest.mark.parametrize("q", Q)
def test_q(q):
    assert translate(q) == Q[q]


def test_q_runs(pipe, spark):
    e = Engine(spark).register("trades", pipe.ticks())
    assert e.sql(translate("select n: count i, v: sum volume by symbol from trades where price > 15040")).where("symbol = 1").first()["n"] == 5
    with pytest.raises(QError):
        translate("select frobnicate price from trades")


def test_ddl(pipe):
    df = pipe.ticks()
    assert "MergeTree() PARTITION BY toYYYYMMDD(timestamp) ORDER BY (symbol, timestamp)" in ddl.create_table(df, "t", "clickhouse")
    assert "create_hypertable('t', 'timestamp')" in ddl.create_table(df, "t", "timescale")
    assert "price DOUBLE" in ddl.create_table(df, "t", "duckdb")
    assert "time_bucket('5 minutes', timestamp)" in ddl.continuous_aggregate("v", "t", "5 minutes")
    with pytest.raises(ValueError, match="unknown engine"):
        ddl.create_table(df, "t", "oracle")
