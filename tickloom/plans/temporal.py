"""Queries of the window functions, the time joins, DML and materialized views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.catalog import deleted, insert_rows, updated
from tickloom.functions.time import micros
from tickloom.mview import bars_view
from tickloom.operators import joins as J
from tickloom.operators import windows as W
from tickloom.plans import relational

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    def put(f):
        relational.query(name, sql, *tables)(f)
        QUERIES[name] = relational.QUERIES.pop(name)
        if sql:
            ORACLES[name] = relational.ORACLES.pop(name)
        return f

    return put


OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def window(name: str, expr: str, column):
    """A window function over each user's events in order of time."""

    @query(name, f"SELECT event_id, {expr} AS x FROM events", "events")
    def _(t):
        return t.select("event_id", column().alias("x"))


window("win_row_number", f"CAST(row_number() {OVER} AS INTEGER)", lambda: F.row_number().over(by_user()))
window("win_sum_running", f"round(sum(value) {OVER}, 4)", lambda: F.round(F.sum("value").over(by_user()), 4))
window("win_avg_moving", f"round(avg(value) {OVER[:-1]} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6)", lambda: F.round(F.avg("value").over(by_user().rowsBetween(-9, 0)), 6))
window("win_min_moving", f"min(value) {OVER[:-1]} ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING)", lambda: F.min("value").over(by_user().rowsBetween(-5, 2)))
window("win_max_moving", f"max(value) {OVER[:-1]} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)", lambda: F.max("value").over(by_user().rowsBetween(-5, 0)))
window("win_count", f"count(*) {OVER}", lambda: F.count(F.lit(1)).over(by_user()))
window("win_lag", f"lag(value, 2, 0) {OVER}", lambda: F.lag("value", 2, 0.0).over(by_user()))
window("win_lead", f"lead(value, 1, 0) {OVER}", lambda: F.lead("value", 1, 0.0).over(by_user()))
window("win_delta", f"value - lag(value, 1, 0) {OVER}", lambda: W.delta("value", by_user()))
window(
    "win_ratio",
    f"CASE WHEN row_number() {OVER} = 1 THEN 1000000 WHEN lag(value) {OVER} = 0 THEN 0 ELSE CAST(trunc(value / lag(value) {OVER} * 1000000) AS BIGINT) END",
    lambda: W.ratio("value", by_user()),
)
window("win_rank", "CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id) AS INTEGER)", lambda: F.rank().over(Window.partitionBy("event_type").orderBy("user_id")))
window("win_dense_rank", "CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS INTEGER)", lambda: F.dense_rank().over(Window.partitionBy("event_type").orderBy("user_id")))
window("win_ntile", f"CAST(ntile(4) {OVER} AS INTEGER)", lambda: F.ntile(4).over(by_user()))


def _ema_sql(alpha: str) -> str:
    """Recursive: each row's average from the one before it."""
    return f"""WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value, row_number() {OVER} AS rn FROM events),
  e AS (SELECT user_id, ts, event_id, value, rn, value AS ema FROM s WHERE rn = 1
    UNION ALL SELECT s.user_id, s.ts, s.event_id, s.value, s.rn, {alpha} * s.value + (1 - {alpha}) * e.ema FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1)
SELECT event_id, round(ema, 4) AS ema FROM e"""


@query("win_ema_period", _ema_sql("CAST(2 AS DOUBLE) / 21"), "events")
def _(t):
    return W.ema(t, "user_id", ["ts", "event_id"], "value", period=20).select("event_id", F.round("ema", 4).alias("ema"))


@query("win_ema_alpha", _ema_sql("CAST(1 AS DOUBLE) / 3"), "events")
def _(t):
    return W.ema(t, "user_id", ["ts", "event_id"], "value", alpha=1 / 3).select("event_id", F.round("ema", 4).alias("ema"))


@query("join_inner", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'", "lineitem", "orders")
def _(li, o):
    return li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("o_orderpriority").like("1%")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_totalprice")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "customer", "orders")
def _(c, o):
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT o_orderkey, c_name FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0", "customer", "orders")
def _(c, o):
    return c.join(o, (c.c_custkey == o.o_custkey) & (c.c_acctbal > 0), "right").select("o_orderkey", "c_name")


@query("join_full", "SELECT t.symbol AS t_symbol, q.symbol AS q_symbol FROM (SELECT DISTINCT symbol FROM trades) t FULL JOIN (SELECT DISTINCT symbol FROM quotes) q ON t.symbol = q.symbol", "trades", "quotes")
def _(t, q):
    a, b = t.select(F.col("symbol").alias("t_symbol")).distinct(), q.select(F.col("symbol").alias("q_symbol")).distinct()
    return a.join(b, F.col("t_symbol") == F.col("q_symbol"), "full")


@query("join_post_where", "SELECT query_id, d.selected_action, quality_label FROM fleet_decision_table d JOIN edge_outbox_table o USING (query_id) WHERE quality_label LIKE 'risky%' AND d.edge_latency_ms > 10", "fleet_decision_table", "edge_outbox_table")
def _(d, o):
    right = o.where(F.col("quality_label").like("risky%")).select("query_id", "quality_label")
    return d.where("edge_latency_ms > 10").select("query_id", "selected_action").join(right, "query_id")


@query("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey", "customer", "orders")
def _(c, o):
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti", "SELECT quote_id, symbol FROM quotes q ANTI JOIN trades t ON q.symbol = t.symbol", "quotes", "trades")
def _(q, t):
    return q.join(t.select("symbol").distinct(), "symbol", "left_anti").select("quote_id", "symbol")


_TICKS = """t AS (SELECT DISTINCT trade_id, symbol, epoch_us("timestamp") AS us, price FROM trades WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND price IS NOT NULL),
  q AS (SELECT symbol, epoch_us("timestamp") AS us, max(quote_id) AS quote_id FROM quotes WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1, 2)"""
HOUR_US = 3_600_000_000


def _ticks(t, q):
    trades = t.select("trade_id", "symbol", micros(F.col("timestamp")).alias("us"), "price").na.drop().distinct()
    quotes = q.select("quote_id", "symbol", micros(F.col("timestamp")).alias("us")).na.drop()
    return trades, quotes


@query("join_asof", f"WITH {_TICKS} SELECT trade_id, quote_id FROM t ASOF JOIN q ON t.symbol = q.symbol AND t.us >= q.us", "trades", "quotes")
def _(t, q):
    return J.asof_join(*_ticks(t, q), ["symbol"], "us", "us", take=["quote_id"], bucket=HOUR_US).select("trade_id", "quote_id")


@query("join_asof_left", f"WITH {_TICKS} SELECT trade_id, quote_id FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.us >= q.us", "trades", "quotes")
def _(t, q):
    return J.asof_join(*_ticks(t, q), ["symbol"], "us", "us", take=["quote_id"], how="left", bucket=HOUR_US).select("trade_id", "quote_id")


@query("join_aj0", f"WITH {_TICKS} SELECT t.* FROM t ASOF JOIN q ON t.symbol = q.symbol AND t.us >= q.us", "trades", "quotes")
def _(t, q):
    return J.aj0(*_ticks(t, q), ["symbol"], "us", "us", bucket=HOUR_US)


for _fn in ("avg", "sum", "count", "min", "max"):

    @query(
        f"join_wj_{_fn}",
        f"WITH {_TICKS} SELECT t.trade_id, round(coalesce(CAST({_fn}(b.price) AS DOUBLE), 0), 4) AS x FROM t LEFT JOIN t b ON b.symbol = t.symbol AND b.us BETWEEN t.us - 60000000 AND t.us + 30000000 GROUP BY t.trade_id",
        "trades", "quotes",
    )
    def _(t, q, fn=_fn):
        trades, _ = _ticks(t, q)
        joined = J.window_join(trades, trades, ["symbol"], "us", "us", 60_000_000, 30_000_000, {"x": (fn, "price")})
        return joined.select("trade_id", F.round(F.col("x").cast("double"), 4).alias("x"))


@query("join_uj", 'SELECT trade_id, symbol, price, NULL AS quote_id, NULL AS bid FROM trades UNION ALL SELECT NULL, symbol, NULL, quote_id, bid FROM quotes', "trades", "quotes")
def _(t, q):
    return J.union_join(t.select("trade_id", "symbol", "price"), q.select("quote_id", "symbol", "bid"))


@query(
    "join_pj",
    "SELECT p_partkey, p_size + coalesce(s.more, 0) AS p_size FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_suppkey)) AS more FROM lineitem GROUP BY 1) s ON p_partkey = l_partkey",
    "part", "lineitem",
)
def _(p, li):
    right = li.select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("p_size"), "l_orderkey", "l_suppkey")
    return J.plus_join(p.select("p_partkey", "p_size"), right, ["p_partkey"], ["l_orderkey", "p_size", "l_suppkey"])


@query("dml_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NEW' UNION ALL SELECT 91, NULL", "region")
def _(r):
    return insert_rows(r.select("r_regionkey", "r_name"), [{"r_regionkey": 90, "r_name": "NEW"}, {"r_regionkey": 91}])


@query("dml_update", "SELECT trade_id, CASE WHEN price <= 0 THEN 0 ELSE price END AS price FROM trades", "trades")
def _(t):
    return updated(t.select("trade_id", "price"), "price <= 0", {"price": "0"})


@query("dml_delete", "SELECT trade_id, volume FROM trades WHERE NOT coalesce(volume < 100, false)", "trades")
def _(t):
    return deleted(t.select("trade_id", "volume"), "volume < 100")


@query("mv_ohlcv", relational._BARS, "trades")
def _(t):
    half = F.col("trade_id") % 2 == 0
    view = bars_view("symbol", "timestamp", "price", "volume", ["trade_id"], 300)
    rows = t.where("symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL")
    state = view.merge(view.partial(rows.where(half)), view.partial(rows.where(~half)))
    return view.final(state).withColumn("vwap", F.round("vwap", 4)).withColumnRenamed("bar", "bar_s")


@query("mv_rewrite", 'SELECT symbol, epoch_us("timestamp") // 3600000000 * 3600 AS bar, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM trades WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2', "trades")
def _(t):
    fine = bars_view("symbol", "timestamp", "price", "volume", ["trade_id"], 300)
    state = fine.partial(t.where("symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL"))
    return fine.coarser(3600).final(fine.rolled(state, 3600)).select("symbol", "bar", "n", "volume")
