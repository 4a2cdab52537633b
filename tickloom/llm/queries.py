"""Queries of problems 4, 5, 7, 8 and 9, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import abuse, nearest, packing, radix, tokens
from tickloom.llm.learned import Weights
from tickloom.storage import table

STATION = ["run_id", "line", "station"]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.percentiles(table(spark, sf_dir, "factory_ticks"), STATION, "price", [50, 95])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_percentiles(spark, sf_dir).where(F.col("p95") >= 1.6 * F.col("p50")).select(*STATION)


def p4_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "factory_ticks").withColumn("day", F.to_date("tick_time"))
    days = radix.histogram(ticks, [*STATION, "day"], "price")
    return radix.percentiles_of(radix.merge(days, STATION), STATION, [50, 95])


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "trades").where(F.col("price") > 0)
    return nearest.nearest_in_time(
        table(spark, sf_dir, "quotes"), trades, "symbol", "timestamp", "quote_id", "trade_id", tolerance_us=500_000
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_nearest(spark, sf_dir).select("quote_id", "trade_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pack(spark, sf_dir).where("piece = 1").select("doc_id")


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Weights | None]:
    documents = table(spark, sf_dir, "documents")
    return documents, abuse.weights_of(documents, table(spark, sf_dir, "labels"), "doc_id", "text", "abusive")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, weights = _reviewed(spark, sf_dir)
    return abuse.scores(documents, "doc_id", "text", weights)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, weights = _reviewed(spark, sf_dir)
    return abuse.rates(documents, "doc_id", "text", "source", weights)


QUERIES = {f.__name__: f for f in (p4_found, p4_percentiles, p4_mergeable, p5_found, p5_nearest, p7_ids, p8_found, p8_pack, p9_found, p9_scores, p9_rates)}

_RANKS = """v AS (SELECT run_id, line, station, price, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, line, station) AS n
    FROM factory_ticks WHERE isfinite(price) AND line IS NOT NULL AND station IS NOT NULL AND run_id IS NOT NULL
    WINDOW w AS (PARTITION BY run_id, line, station ORDER BY price)),
  q AS (SELECT run_id, line, station, max(n) AS n, max(CASE WHEN i = 50 * (n - 1) // 100 THEN price END) AS p50,
    max(CASE WHEN i = 95 * (n - 1) // 100 THEN price END) AS p95 FROM v GROUP BY 1, 2, 3)"""
_NEAREST = """t AS (SELECT symbol, epoch_us("timestamp") AS us, min(trade_id) AS trade_id FROM trades
    WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL AND price > 0 GROUP BY 1, 2),
  q AS (SELECT DISTINCT quote_id, symbol, epoch_us("timestamp") AS us FROM quotes WHERE symbol IS NOT NULL AND "timestamp" IS NOT NULL),
  b AS (SELECT q.quote_id, t.trade_id, t.us - q.us AS gap FROM q ASOF JOIN t ON q.symbol = t.symbol AND q.us >= t.us),
  a AS (SELECT q.quote_id, t.trade_id, t.us - q.us AS gap FROM q ASOF JOIN t ON q.symbol = t.symbol AND q.us <= t.us),
  u AS (SELECT quote_id, trade_id, gap, row_number() OVER (PARTITION BY quote_id ORDER BY abs(gap), gap) AS k
    FROM (FROM b UNION ALL FROM a))"""

ORACLES = {
    "p4_found": f"WITH {_RANKS} SELECT run_id, line, station FROM q WHERE p95 >= 1.6 * p50",
    "p4_percentiles": f"WITH {_RANKS} SELECT run_id, line, station, n, p50, p95 FROM q",
    "p5_found": f"WITH {_NEAREST} SELECT quote_id, trade_id FROM u WHERE k = 1 AND abs(gap) <= 500000",
    "p5_nearest": f"WITH {_NEAREST} SELECT quote_id, trade_id, gap AS gap_us FROM u WHERE k = 1 AND abs(gap) <= 500000",
}
