"""Queries run as streams over the events' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.problems import EVENT_TIMES, decision_times
from tickloom.plans.temporal import _ema_sql
from tickloom.streaming import windows as S
from tickloom.streaming.late import corrected_counts


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_stream(spark, f"{sf_dir}/events.parquet", "ts")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.bars(_events(spark, sf_dir), "ts", ["event_type"], "1 hour", "1 hour")
    return S.run_available(out, "complete").select("event_type", "start_us", "n", F.round("total", 3).alias("total"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.bars(_events(spark, sf_dir), "ts", ["event_type"], "2 hours", "1 hour", "1 hour")
    return S.run_available(out, "complete").select("event_type", "start_us", "n")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_available(S.sessions(_events(spark, sf_dir), "ts", ["user_id"], "6 hours", "1 hour"), "complete")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; rows that come after it are dropped."""
    out = S.bars(_events(spark, sf_dir), "ts", ["event_type"], "1 hour", "2 hours")
    return S.run_available(out, "append").select("event_type", "start_us", "n")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.once_each(_events(spark, sf_dir), "ts", ["event_id"], "40 days")
    return S.run_available(rows.select("event_id", "user_id"), "append")


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    flat = rows.select("user_id", F.concat(F.lpad(F.unix_micros("at.ts").cast("string"), 20, "0"), F.lit("|"), F.col("at.event_id").cast("string")).alias("turn"), "value")
    out = S.run_available(S.stateful_ema(flat, "user_id", "turn", "value", period=20), "append")
    return out.select(F.split_part("turn", F.lit("|"), F.lit(2)).cast("bigint").alias("event_id"), F.round("ema", 4).alias("ema"))


def stream_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per period of decision time as they stand after all corrections, by checkpoint and replay; a busy day is salted by node."""
    rows = decision_times(S.file_stream(spark, f"{sf_dir}/fleet_decision_table.parquet", "timestamp"), "source_edge_node_id")
    day = F.expr(f"decision_ns div {86_400 * 10**9}")
    keyed = rows.where("decision_ns IS NOT NULL AND consolidated_ns IS NOT NULL").withColumn("part", F.concat_ws("/", day, F.pmod(F.coalesce("source_edge_node_id", F.lit(0)), F.lit(8))))
    changes = S.run_available(corrected_counts(keyed, "part", "decision_ns", "consolidated_ns"), "append")
    last = changes.groupBy("part", "period_start_s").agg(F.max("n").alias("n"))
    return last.groupBy("period_start_s").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_late, stream_dedup, stream_ema, stream_corrected)}
_HOUR = "epoch_us(ts) // 3600000000 * 3600000000"
ORACLES = {
    "stream_tumbling": f"SELECT event_type, {_HOUR} AS start_us, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": f"""SELECT event_type, start_us, count(*) AS n FROM (SELECT event_type, unnest([{_HOUR}, {_HOUR} - 3600000000]) AS start_us FROM events) GROUP BY 1, 2""",
    "stream_session": """WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000 AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_corrected": f"""WITH {EVENT_TIMES}
SELECT d // 300000000000 * 300 AS period_start_s, count(*) AS n FROM u
WHERE d IS NOT NULL AND c IS NOT NULL AND c <= (d // 300000000000 + 1) * 300000000000 + 900000000000 GROUP BY 1""",
    "stream_ema": _ema_sql("CAST(2 AS DOUBLE) / 21"),
}
