"""Queries of the general problems 1, 2, 3 and 6 over trades, fleet_decision_table and edge_outbox_table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.time import nanos_of
from tickloom.operators import dedup, grid, late, skew
from tickloom.storage import table


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(
        table(spark, sf_dir, "trades"), "symbol", "timestamp", "price", tie="trade_id", valid=F.col("price") > 0
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where(F.col("state") == grid.GAP).select("symbol", "period_start_s")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.unusual_values(table(spark, sf_dir, "trades"), "symbol", "timestamp", "trade_id", "volume").select("symbol", "trade_id")


def p2_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trades").where("timestamp is not null and volume > 0")
    return skew.numbered(rows, "symbol", ["timestamp", "trade_id"], []).select(
        F.col("k").alias("symbol"), F.col("o1").alias("trade_id"), "rn"
    )


def decision_times(raw: DataFrame, *keep: str) -> DataFrame:
    """Decision and consolidation time in nanoseconds; a missing one follows from the other and the lag."""
    decided, consolidated = nanos_of(F.col("decision_ts_ns")), nanos_of(F.col("consolidated_ts_ns"))
    lag = F.col("consolidation_lag_ms") * F.lit(1_000_000)
    return raw.select(*keep, F.coalesce(decided, consolidated - lag).alias("decision_ns"), F.coalesce(consolidated, decided + lag).alias("consolidated_ns"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = decision_times(table(spark, sf_dir, "fleet_decision_table"), "query_id")
    return late.first_arrivals(times, "query_id", "decision_ns", "consolidated_ns")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        late.event_status(_decisions(spark, sf_dir), "query_id", "decision_ns", "consolidated_ns")
        .where(F.col("status") == late.CORRECTED)
        .select(F.col("id").alias("query_id"), F.expr("period_ns div 1000000000").alias("period_start_s"))
    )


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.corrected_counts(_decisions(spark, sf_dir), "query_id", "decision_ns", "consolidated_ns")


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    return table(spark, sf_dir, "edge_outbox_table"), ("outbox_row_id", "source_edge_node_id", "feed_event_id", "stream_seq")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _messages(spark, sf_dir)
    return dedup.message_rows(rows, *columns).where("dup").select("outbox_row_id")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _messages(spark, sf_dir)
    return dedup.deduplicate(rows, *columns)


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_numbered, p3_found, p3_counts, p6_found, p6_kept)}

_READINGS = """r AS (SELECT symbol, epoch_us("timestamp") AS us, trade_id, price FROM trades
  WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND price > 0)"""
_SEQ = """t AS (SELECT symbol, "timestamp" AS ts, trade_id, min(volume) AS v FROM trades
  WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND volume > 0 GROUP BY ALL)"""


def _scaled(c: str) -> str:
    s = 1_704_067_200
    return (
        f"CASE WHEN {c} >= {s}000000000 THEN {c} WHEN {c} >= {s}000000 THEN {c} * 1000 "
        f"WHEN {c} >= {s}000 THEN {c} * 1000000 WHEN {c} >= {s} THEN {c} * 1000000000 END"
    )


EVENT_TIMES = f"""n AS (SELECT query_id, {_scaled("decision_ts_ns")} AS d, {_scaled("consolidated_ts_ns")} AS c,
    consolidation_lag_ms * 1000000 AS lag FROM fleet_decision_table),
  u AS (SELECT query_id, coalesce(d, c - lag) AS d, coalesce(c, d + lag) AS c FROM n)"""
_EVENTS = f"""{EVENT_TIMES},
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, d) AS k FROM u WHERE d IS NOT NULL AND c IS NOT NULL),
  e AS (SELECT query_id, d, c, (d // 300000000000 + 1) * 300000000000 AS p_end FROM o WHERE k = 1)"""
_COPIES = r"""b AS (SELECT outbox_row_id AS id, source_edge_node_id AS node, stream_seq AS seq,
    nullif(lower(trim(feed_event_id, E' \t')), '') AS fid FROM edge_outbox_table),
  m AS (SELECT node, seq, arg_min(fid, id) AS fid2 FROM b WHERE fid IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT id, node, CASE WHEN coalesce(fid, fid2) IS NOT NULL THEN 'i' || coalesce(fid, fid2)
      WHEN seq IS NOT NULL THEN 's' || seq ELSE 'r' || id END AS key FROM b LEFT JOIN m USING (node, seq)),
  c AS (SELECT id, row_number() OVER (PARTITION BY node, key ORDER BY id) AS nth FROM k)"""

ORACLES = {
    "p1_found": f"""WITH {_READINGS},
  p AS (SELECT DISTINCT symbol, us // 300000000 AS p FROM r),
  d AS (SELECT symbol, p // 288 AS day, min(p) AS a, max(p) AS b FROM p GROUP BY 1, 2),
  g AS (SELECT symbol, unnest(range(a, b + 1)) AS p FROM d)
SELECT symbol, p * 300 AS period_start_s FROM g ANTI JOIN p USING (symbol, p)""",
    "p1_grid": f"""WITH {_READINGS},
  p AS (SELECT symbol, us // 300000000 AS p, arg_max(price, (us, trade_id, price)) AS v, count(*) AS n FROM r GROUP BY 1, 2),
  x AS (SELECT symbol, p, v, n, lead(p) OVER (PARTITION BY symbol ORDER BY p) AS q FROM p),
  f AS (SELECT symbol, v, n, p, q, unnest(range(p, coalesce(q, p + 1))) AS g FROM x)
SELECT symbol, g * 300 AS period_start_s, v AS "value", CASE WHEN g = p THEN n ELSE 0 END AS n_readings,
  CASE WHEN g = p THEN 'reading' WHEN p // 288 = q // 288 THEN 'gap' ELSE 'carried' END AS state FROM f""",
    "p2_found": f"""WITH {_SEQ},
  w AS (SELECT symbol, trade_id, v, sum(v) OVER b AS s, count(*) OVER b AS c FROM t
    WINDOW b AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, trade_id FROM w WHERE c = 20 AND v * 20 >= 10 * s""",
    "p2_numbered": f"""WITH {_SEQ}
SELECT symbol, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS rn FROM t""",
    "p3_found": f"""WITH {_EVENTS}
SELECT query_id, p_end // 1000000000 - 300 AS period_start_s FROM e WHERE c >= p_end AND c <= p_end + 900000000000""",
    "p3_counts": f"""WITH {_EVENTS},
  a AS (SELECT p_end, CASE WHEN c < p_end THEN p_end ELSE (c // 60000000000 + 1) * 60000000000 END AS pub FROM e
    WHERE c <= p_end + 900000000000),
  s AS (SELECT p_end, pub, count(*) AS n FROM a GROUP BY 1, 2)
SELECT p_end // 1000000000 - 300 AS period_start_s, pub // 1000000000 AS published_s,
  CAST(sum(n) OVER w AS BIGINT) AS n, CAST(row_number() OVER w AS INTEGER) AS version FROM s
  WINDOW w AS (PARTITION BY p_end ORDER BY pub)""",
    "p6_found": f"WITH {_COPIES} SELECT id AS outbox_row_id FROM c WHERE nth > 1",
    "p6_kept": f"WITH {_COPIES} SELECT e.* FROM edge_outbox_table e SEMI JOIN (SELECT id FROM c WHERE nth = 1) k ON e.outbox_row_id = k.id",
}
