"""Statements of the tick dialect over the test tables, each with plain SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.temporal import _TICKS, _ema_sql
from tickloom.sql import Engine
from tickloom.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def statement(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for t in ("trades", "quotes", "events", "orders", "customer", "lineitem"):
            engine.register(t, table(spark, sf_dir, t))
        return engine.sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle


NS = 'epoch_us("timestamp") * 1000'

statement(
    "sql_bars",
    """SELECT symbol, xbar(timestamp, 300_000_000_000) AS bar, max(price) AS high, sum(volume) AS volume, count(*) AS n
       FROM trades WHERE symbol IS NOT NULL AND timestamp IS NOT NULL GROUP BY symbol, xbar(timestamp, 300_000_000_000) ORDER BY bar, symbol""",
    f"SELECT symbol, {NS} // 300000000000 * 300000000000 AS bar, max(price) AS high, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM trades WHERE symbol IS NOT NULL AND \"timestamp\" IS NOT NULL GROUP BY 1, 2",
)
statement(
    "sql_asof",
    """SELECT t.trade_id, q.quote_id FROM (SELECT DISTINCT trade_id, symbol, timestamp FROM trades WHERE symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL) AS t
       ASOF JOIN (SELECT symbol, timestamp, max(quote_id) AS quote_id FROM quotes WHERE symbol IS NOT NULL AND timestamp IS NOT NULL GROUP BY symbol, timestamp) AS q
       ON t.symbol = q.symbol AND t.timestamp >= q.timestamp""",
    f"WITH {_TICKS} SELECT trade_id, quote_id FROM t ASOF JOIN q ON t.symbol = q.symbol AND t.us >= q.us",
)
statement(
    "sql_window_join",
    """SELECT t.trade_id, wj_count(q.price) AS n, wj_max(q.price) AS high FROM (SELECT DISTINCT trade_id, symbol, timestamp FROM trades WHERE symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL) AS t
       WINDOW JOIN (SELECT DISTINCT trade_id, symbol, timestamp, price FROM trades WHERE price IS NOT NULL) AS q
       ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - INTERVAL '30 s' AND t.timestamp + INTERVAL '1 min'""",
    f"WITH {_TICKS} SELECT t.trade_id, count(b.price) AS n, max(b.price) AS high FROM t LEFT JOIN t b ON b.symbol = t.symbol AND b.us BETWEEN t.us - 30000000 AND t.us + 60000000 GROUP BY 1",
)
statement(
    "sql_windows",
    """SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING) AS s, LAG(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts) AS before,
       DELTA(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS d, RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM events""",
    """SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(event_id, 1, 0) OVER w AS before,
       event_id - lag(event_id, 1, 0) OVER w AS d, CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id) AS INTEGER) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
statement(
    "sql_ema",
    "SELECT event_id, ROUND(EMA(value, 20) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS ema FROM events",
    _ema_sql("CAST(2 AS DOUBLE) / 21"),
)
statement(
    "sql_cte_having",
    """WITH a AS (SELECT symbol, count(*) AS n, avg(price) AS mean FROM trades GROUP BY symbol HAVING n > 20)
       SELECT symbol, n, price_class, n / 0 AS zero FROM (SELECT symbol, n, CASE WHEN mean > 20000 THEN 1 END AS price_class FROM a) AS b WHERE symbol IN (SELECT symbol FROM quotes)""",
    """WITH a AS (SELECT symbol, count(*) AS n, avg(price) AS mean FROM trades GROUP BY symbol HAVING count(*) > 20)
       SELECT symbol, n, CASE WHEN mean > 20000 THEN 1 ELSE 0 END AS price_class, CAST(0 AS BIGINT) AS zero FROM a WHERE symbol IN (SELECT symbol FROM quotes)""",
)
statement(
    "sql_set_ops",
    "SELECT symbol FROM trades WHERE price > 20000 INTERSECT SELECT symbol FROM quotes EXCEPT SELECT symbol FROM quotes WHERE bid > 600",
    "SELECT symbol FROM trades WHERE price > 20000 INTERSECT SELECT symbol FROM quotes EXCEPT SELECT symbol FROM quotes WHERE bid > 600",
)
statement(
    "sql_join_group",
    "SELECT c.c_mktsegment, COUNT(*) AS n, MAX(o.o_totalprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority LIKE '1%' GROUP BY c.c_mktsegment ORDER BY n DESC",
    "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%' GROUP BY 1",
)
statement("sql_time", "SELECT event_id, EPOCH_S(ts) AS s, DATE_TRUNC('week', ts) AS w FROM events WHERE ts > NOW() - INTERVAL '100000 days'", "SELECT event_id, epoch_ns(ts) // 1000000000 AS s, epoch_ns(ts) // 604800000000000 * 604800000000000 AS w FROM events")
