"""Queries of the filters, scalar functions, aggregates, sorts and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import exprs as X
from tickloom.functions.time import micros, wall_ns
from tickloom.operators import aggs as A
from tickloom.operators import joins as J
from tickloom.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    """Registers a function of the named tables under a name, with its SQL."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[name] = sql
        return f

    return put


ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
ITEMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("scan_project", f"SELECT {ITEM}, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "lineitem")
def _(t):
    return t.select(*ITEMS, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("filter_cmp", "SELECT trade_id, symbol, price FROM trades WHERE price > 20000 AND volume <= 500 AND exchange <> 'XALP'", "trades")
def _(t):
    return t.where((F.col("price") > 20000) & (F.col("volume") <= 500) & (F.col("exchange") != "XALP")).select("trade_id", "symbol", "price")


@query("filter_between", "SELECT trade_id, volume FROM trades WHERE volume BETWEEN 100 AND 300", "trades")
def _(t):
    return t.where(F.col("volume").between(100, 300)).select("trade_id", "volume")


@query("filter_and_or_not", "SELECT trade_id FROM trades WHERE (price > 30000 OR volume > 1000) AND NOT (exchange = 'XBRV' OR msg_type = 1)", "trades")
def _(t):
    return t.where(((F.col("price") > 30000) | (F.col("volume") > 1000)) & ~((F.col("exchange") == "XBRV") | (F.col("msg_type") == 1))).select("trade_id")


@query("filter_in", "SELECT trade_id, exchange FROM trades WHERE exchange IN ('XALP', 'XCED')", "trades")
def _(t):
    return t.where(F.col("exchange").isin("XALP", "XCED")).select("trade_id", "exchange")


@query("filter_symbol_in", "SELECT symbol, count(*) AS n FROM trades WHERE symbol IN (SELECT min(symbol) FROM trades UNION SELECT max(symbol) FROM trades) GROUP BY 1", "trades")
def _(t):
    return J.semi_in(t, "symbol", t.agg(F.min("symbol")).union(t.agg(F.max("symbol")))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("filter_is_null", "SELECT trade_id FROM trades WHERE price IS NULL AND volume IS NOT NULL", "trades")
def _(t):
    return t.where(F.col("price").isNull() & F.col("volume").isNotNull()).select("trade_id")


@query("filter_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'", "events")
def _(t):
    return t.where("ts BETWEEN TIMESTAMP_NTZ '2024-01-10 00:00:00' AND TIMESTAMP_NTZ '2024-01-20 12:00:00'").select("event_id")


@query("filter_like", "SELECT trade_id, price FROM trades WHERE CAST(price AS VARCHAR) LIKE '1%_7'", "trades")
def _(t):
    return t.where(X.like_num("price", "1%_7")).select("trade_id", "price")


@query("filter_not_like", "SELECT query_id, selected_action FROM fleet_decision_table WHERE selected_action NOT LIKE '%bay'", "fleet_decision_table")
def _(t):
    return t.where(~F.col("selected_action").like("%bay")).select("query_id", "selected_action")


@query("filter_literal", "SELECT trade_id FROM trades WHERE 1 = 1 AND symbol = msg_type + 3120", "trades")
def _(t):
    return t.where("1 = 1 AND symbol = msg_type + 3120").select("trade_id")


@query("filter_expr_string", "SELECT trade_id FROM trades WHERE price > 100 AND volume * 10 > 50000", "trades")
def _(t):
    return t.where(F.expr("price > 100 AND volume * 10 > 50000")).select("trade_id")


LAT, LON = "(l_suppkey % 90)", "(l_partkey % 180)"
_HAV = (
    "2 * 6371008.8 * atan2(sqrt(a), sqrt(1 - a)) FROM (SELECT *, least(1.0, greatest(0.0, pow(sin(radians({lat} - 40) / 2), 2) + cos(radians(40)) * cos(radians({lat}))"
    " * pow(sin(radians({lon} - 20) / 2), 2))) AS a FROM lineitem)"
).format(lat=LAT, lon=LON)


def _distance():
    lat, lon = (F.expr(x).cast("double") for x in (LAT, LON))
    return X.haversine_m(F.lit(40.0), F.lit(20.0), lat, lon)


@query("haversine", f"SELECT {ITEM}, round({_HAV.split(' FROM ')[0]}, 2) AS metres FROM{_HAV.split(' FROM', 1)[1]}", "lineitem")
def _(t):
    return t.select(*ITEMS, F.round(_distance(), 2).alias("metres"))


@query("st_within", f"SELECT {ITEM} FROM (SELECT {ITEM}, {_HAV.split(' FROM ')[0]} AS d FROM{_HAV.split(' FROM', 1)[1]}) WHERE d <= 3000000", "lineitem")
def _(t):
    lat, lon = (F.expr(x).cast("double") for x in (LAT, LON))
    return t.where(X.st_within(lat, lon, F.lit(40.0), F.lit(20.0), 3_000_000)).select(*ITEMS)


@query("filter_func_spatial", f"SELECT {ITEM} FROM (SELECT {ITEM}, {_HAV.split(' FROM ')[0]} AS d FROM{_HAV.split(' FROM', 1)[1]}) WHERE d BETWEEN 1000000 AND 2000000", "lineitem")
def _(t):
    return t.where(_distance().between(1_000_000, 2_000_000)).select(*ITEMS)


@query("case_when", "SELECT trade_id, CASE WHEN volume > 1000 THEN 2 WHEN volume > 200 THEN 1 ELSE 0 END AS size_class FROM trades", "trades")
def _(t):
    return t.select("trade_id", F.when(F.col("volume") > 1000, 2).when(F.col("volume") > 200, 1).otherwise(0).alias("size_class"))


@query("arith_div_zero", "SELECT trade_id, CASE WHEN msg_type = 0 THEN 0 ELSE price // msg_type END AS q FROM trades", "trades")
def _(t):
    return t.select("trade_id", X.int_div("price", "msg_type").alias("q"))


@query("distinct_rows", "SELECT DISTINCT symbol, exchange FROM trades", "trades")
def _(t):
    return t.select("symbol", "exchange").distinct()


_H = "((1 * 1103515245 + (trade_id % 2147483647) * 48271 + 12345) % 2147483647)"


@query("sample_hash", f"SELECT trade_id, price FROM trades WHERE ({_H} * 69621) % 2147483647 < 214748364", "trades")
def _(t):
    return t.where(X.sampled(0.1, "trade_id")).select("trade_id", "price")


@query("scalar_subquery", "SELECT trade_id, price FROM trades WHERE price > (SELECT avg(price) FROM trades)", "trades")
def _(t):
    mean = t.agg(F.avg("price").alias("mean"))
    return t.crossJoin(F.broadcast(mean)).where("price > mean").select("trade_id", "price")


@query("in_subquery", "SELECT trade_id FROM trades WHERE symbol IN (SELECT symbol FROM quotes WHERE bid > 500)", "trades", "quotes")
def _(t, q):
    return J.semi_in(t.select("trade_id", "symbol"), "symbol", q.where("bid > 500").select("symbol")).select("trade_id")


@query("not_in_subquery", "SELECT quote_id FROM quotes WHERE symbol NOT IN (SELECT symbol FROM trades WHERE symbol IS NOT NULL)", "quotes", "trades")
def _(q, t):
    traded = t.where("symbol IS NOT NULL").select("symbol").distinct()
    return J.anti_in(q.where("symbol IS NOT NULL").select("quote_id", "symbol"), "symbol", traded).select("quote_id")


@query(
    "agg_scalar",
    "SELECT count(*) AS n, count(price) AS n_price, CAST(sum(volume) AS BIGINT) AS volume, round(avg(price), 6) AS mean, min(price) AS low, max(price) AS high FROM trades",
    "trades",
)
def _(t):
    return t.agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.sum("volume").alias("volume"), F.round(F.avg("price"), 6).alias("mean"),
        F.min("price").alias("low"), F.max("price").alias("high"),
    )


@query("agg_count_distinct", "SELECT exchange, count(DISTINCT symbol) AS symbols FROM trades GROUP BY 1", "trades")
def _(t):
    return t.groupBy("exchange").agg(F.count_distinct("symbol").alias("symbols"))


@query("agg_group_single", "SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, round(avg(price), 6) AS mean FROM trades GROUP BY 1", "trades")
def _(t):
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.round(F.avg("price"), 6).alias("mean"))


@query("agg_group_multi", "SELECT symbol, exchange, msg_type, max(price) AS high, CAST(sum(volume) AS BIGINT) AS volume FROM trades GROUP BY 1, 2, 3", "trades")
def _(t):
    return t.groupBy("symbol", "exchange", "msg_type").agg(F.max("price").alias("high"), F.sum("volume").alias("volume"))


@query("agg_having", "SELECT symbol, count(*) AS n FROM trades GROUP BY 1 HAVING count(*) > 100 AND max(price) IS NOT NULL", "trades")
def _(t):
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high")).where("n > 100 AND high IS NOT NULL").drop("high")


_PV = "price IS NOT NULL AND volume IS NOT NULL"


@query(
    "agg_vwap",
    f"SELECT symbol, round(CASE WHEN sum(volume) FILTER ({_PV}) > 0 THEN sum(CAST(price AS DOUBLE) * volume) FILTER ({_PV}) / sum(volume) FILTER ({_PV}) END, 4) AS vwap FROM trades GROUP BY 1",
    "trades",
)
def _(t):
    return t.groupBy("symbol").agg(F.round(A.vwap("price", "volume"), 4).alias("vwap"))


@query(
    "agg_first_last",
    'SELECT symbol, arg_min(price, ("timestamp", trade_id)) AS first_price, arg_max(price, ("timestamp", trade_id)) AS last_price FROM trades '
    'WHERE price IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1',
    "trades",
)
def _(t):
    rows = t.where("price IS NOT NULL AND timestamp IS NOT NULL")
    return rows.groupBy("symbol").agg(A.first_by("price", "timestamp", "trade_id").alias("first_price"), A.last_by("price", "timestamp", "trade_id").alias("last_price"))


@query("agg_stddev_var", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY 1", "lineitem")
def _(t):
    return t.groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"))


_LOWER = "list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(floor({p} * (count({c}) - 1) / 100) AS BIGINT) + 1]"


@query("agg_median", f"SELECT symbol, count(price) AS n, {_LOWER.format(c='price', p=50)} AS p50 FROM trades WHERE price IS NOT NULL GROUP BY 1", "trades")
def _(t):
    return A.percentile_lower(t, ["symbol"], "price", [50])


@query("agg_percentile", f"SELECT event_type, count(value) AS n, {_LOWER.format(c='value', p=90)} AS p90, {_LOWER.format(c='value', p=99)} AS p99 FROM events GROUP BY 1", "events")
def _(t):
    return A.percentile_lower(t, ["event_type"], "value", [90, 99])


@query("agg_conditional", "SELECT symbol, CAST(sum(CASE WHEN msg_type = 0 THEN volume ELSE 0 END) AS BIGINT) AS plain_volume FROM trades GROUP BY 1", "trades")
def _(t):
    return t.groupBy("symbol").agg(F.sum(F.when(F.col("msg_type") == 0, F.col("volume")).otherwise(0)).alias("plain_volume"))


@query("agg_expr_sum", "SELECT exchange, CAST(sum(price * volume) AS BIGINT) AS notional FROM trades GROUP BY 1", "trades")
def _(t):
    return t.groupBy("exchange").agg(F.sum(F.col("price") * F.col("volume")).alias("notional"))


@query("agg_rollup", "SELECT exchange, msg_type, count(*) AS n FROM trades WHERE exchange IS NOT NULL GROUP BY ROLLUP (exchange, msg_type)", "trades")
def _(t):
    return t.where("exchange IS NOT NULL").rollup("exchange", "msg_type").agg(F.count(F.lit(1)).alias("n"))


@query("fast_filter_sum", "SELECT CAST(sum(price) AS BIGINT) AS total FROM trades WHERE price > 15000", "trades")
def _(t):
    return A.filter_sum(t, "price", 15000)


_BARS = """SELECT symbol, epoch_us("timestamp") // 300000000 * 300 AS bar_s, arg_min(price, ("timestamp", trade_id)) AS "open", max(price) AS high, min(price) AS low,
  arg_max(price, ("timestamp", trade_id)) AS "close", CAST(sum(volume) AS BIGINT) AS volume,
  round(CASE WHEN sum(volume) > 0 THEN sum(CASE WHEN volume IS NOT NULL THEN CAST(price AS DOUBLE) * volume END) / sum(volume) END, 4) AS vwap, count(*) AS n
FROM trades WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2"""


@query("xbar_ohlcv", _BARS, "trades")
def xbar_ohlcv(t):
    rows = t.where("symbol IS NOT NULL AND timestamp IS NOT NULL")
    bars = A.ohlcv(rows, ["symbol", X.xbar(X.epoch_s(wall_ns(F.col("timestamp"))), 300).alias("bar_s")], "price", "volume", ["timestamp", "trade_id"])
    return bars.withColumn("vwap", F.round("vwap", 4))


for _unit, _width in (("min", 60), ("hour", 3600), ("day", 86_400), ("week", 604_800)):

    @query(f"date_trunc_{_unit}", f"SELECT epoch_ns(ts) // {_width * 10**9} * {_width * 10**9} AS start_ns, count(*) AS n FROM events GROUP BY 1", "events")
    def _(t, unit=_unit):
        return t.groupBy(X.date_trunc_ns(unit, wall_ns(F.col("ts"))).alias("start_ns")).agg(F.count(F.lit(1)).alias("n"))


@query("epoch_s_ms", "SELECT event_id, epoch_ns(ts) // 1000000000 AS s, epoch_ns(ts) // 1000000 AS ms FROM events", "events")
def _(t):
    ns = wall_ns(F.col("ts"))
    return t.select("event_id", X.epoch_s(ns).alias("s"), X.epoch_ms(ns).alias("ms"))


@query("substr_num", "SELECT trade_id, coalesce(TRY_CAST(substr(CAST(price AS VARCHAR), 2, 2) AS BIGINT), 0) AS mid FROM trades", "trades")
def _(t):
    return t.select("trade_id", X.substr_num("price", 2, 2).alias("mid"))


@query("interval_filter", "SELECT event_id FROM events WHERE epoch_ns(ts) > (SELECT max(epoch_ns(ts)) FROM events) - 129600000000000", "events")
def _(t):
    rows = t.select("event_id", wall_ns(F.col("ts")).alias("ns"))
    last = rows.agg(F.max("ns").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("ns") > F.col("last") - F.lit(X.interval_ns("36 hours"))).select("event_id")


@query("orderby_multi", "SELECT trade_id, symbol, price FROM trades ORDER BY symbol NULLS FIRST, price DESC NULLS LAST, trade_id", "trades")
def _(t):
    return t.select("trade_id", "symbol", "price").orderBy(F.asc_nulls_first("symbol"), F.desc_nulls_last("price"), "trade_id")


@query("topn", "SELECT DISTINCT trade_id, volume FROM trades WHERE volume IS NOT NULL ORDER BY volume DESC, trade_id LIMIT 25", "trades")
def _(t):
    return t.where("volume IS NOT NULL").select("trade_id", "volume").distinct().orderBy(F.desc("volume"), "trade_id").limit(25)


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", "orders")
def _(t):
    return t.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("set_union_all", "SELECT symbol FROM trades UNION ALL SELECT symbol FROM quotes", "trades", "quotes")
def _(t, q):
    return t.select("symbol").union(q.select("symbol"))


@query("set_union", "SELECT symbol FROM trades UNION SELECT symbol FROM quotes", "trades", "quotes")
def _(t, q):
    return t.select("symbol").distinct().union(q.select("symbol").distinct()).distinct()


@query("set_intersect", "SELECT symbol FROM trades INTERSECT SELECT symbol FROM quotes", "trades", "quotes")
def _(t, q):
    return t.select("symbol").intersect(q.select("symbol"))


@query("set_except", "SELECT symbol FROM quotes EXCEPT SELECT symbol FROM trades", "trades", "quotes")
def _(t, q):
    return q.select("symbol").subtract(t.select("symbol"))


@query("set_intersect_all", "SELECT symbol FROM quotes INTERSECT ALL SELECT symbol FROM trades", "trades", "quotes")
def _(t, q):
    return q.select("symbol").intersectAll(t.select("symbol"))


@query(
    "cte_chain",
    "WITH a AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1), b AS (SELECT symbol, n FROM a WHERE n > 50) SELECT count(*) AS symbols, CAST(sum(n) AS BIGINT) AS trades FROM b",
    "trades",
)
def _(t):
    a = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return a.where("n > 50").agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("trades"))


@query("derived_table", "SELECT exchange, max(n) AS most FROM (SELECT exchange, symbol, count(*) AS n FROM trades GROUP BY 1, 2) GROUP BY 1", "trades")
def _(t):
    return t.groupBy("exchange", "symbol").agg(F.count(F.lit(1)).alias("n")).groupBy("exchange").agg(F.max("n").alias("most"))


@query("time_micros", 'SELECT trade_id, epoch_us("timestamp") AS us FROM trades', "trades")
def _(t):
    return t.select("trade_id", micros(F.col("timestamp")).alias("us"))
