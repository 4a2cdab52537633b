"""Statements, sources, views, q queries and memory writes over whole test tables, each with plain SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.facade import Pipeline
from tickloom.functions.time import wall_ns
from tickloom.memory import store
from tickloom.migrate.q import translate
from tickloom.sources import arrow, files
from tickloom.sql import Engine
from tickloom.storage import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tickloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with one stored table, ``ticks``, of the trades."""
    engine = Engine(spark, folder(spark, "catalog"))
    engine.sql("CREATE TABLE ticks (trade_id INT64, symbol INT64, timestamp TIMESTAMP_NS, price INT64, volume INT64, exchange STRING)")
    engine.catalog.append("ticks", ticks(spark, sf_dir))
    return engine


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "trades")
    return t.select("trade_id", "symbol", wall_ns(F.col("timestamp")).alias("timestamp"), "price", "volume", "exchange")


NS = 'epoch_us("timestamp") * 1000'
_T = f'SELECT trade_id, symbol, {NS} AS "timestamp", price, volume, exchange FROM trades'


@query("SELECT * FROM (VALUES (1, 'a', 1.5), (2, 'it''s', NULL), (3, NULL, -2.0)) AS v(x, s, y)")
def sql_create_insert(spark, sf_dir):
    engine = Engine(spark, folder(spark, "catalog"))
    engine.sql("CREATE TABLE IF NOT EXISTS v (x INT32, s STRING, y FLOAT64)")
    engine.sql("INSERT INTO v VALUES (1, 'a', 1.5), (2, 'it''s', NULL)")
    engine.sql("INSERT INTO v (x, y) VALUES (3, -2.0)")
    return engine.sql("SELECT * FROM v")


@query(_T)
def sql_stored_table(spark, sf_dir):
    return stored(spark, sf_dir).sql("SELECT * FROM ticks")


@query('SELECT trade_id, symbol, CAST(NULL AS DOUBLE) AS note FROM trades')
def sql_alter_columns(spark, sf_dir):
    engine = stored(spark, sf_dir)
    for change in ("ADD COLUMN note FLOAT64", "DROP COLUMN exchange", "DROP COLUMN price", "DROP COLUMN volume", "DROP COLUMN timestamp"):
        engine.sql(f"ALTER TABLE ticks {change}")
    return engine.sql("SELECT * FROM ticks")


@query(f"SELECT trade_id, symbol, CASE WHEN price > 20000 AND exchange = 'XALP' THEN price * 2 ELSE price END AS price, CASE WHEN price > 20000 AND exchange = 'XALP' THEN 0 ELSE volume END AS volume FROM ({_T}) q")
def sql_update(spark, sf_dir):
    engine = stored(spark, sf_dir)
    engine.sql("UPDATE ticks SET price = price * 2, volume = 0 WHERE price > 20000 AND exchange = 'XALP'")
    return engine.sql("SELECT trade_id, symbol, price, volume FROM ticks")


@query("SELECT trade_id, symbol FROM trades WHERE NOT coalesce(price <= 0 OR volume < 10, false)")
def sql_delete(spark, sf_dir):
    engine = stored(spark, sf_dir)
    engine.sql("DELETE FROM ticks WHERE price <= 0 OR volume < 10")
    return engine.sql("SELECT trade_id, symbol FROM ticks")


def attributed(name: str, attribute: str, column: str, where: str, sql: str) -> None:
    def run(spark, sf_dir):
        engine = stored(spark, sf_dir)
        engine.sql(f"ALTER TABLE ticks SET ATTRIBUTE {column} {attribute}")
        return engine.sql(f"SELECT trade_id, price FROM ticks WHERE {where}")

    QUERIES[name], ORACLES[name] = run, f"SELECT trade_id, price FROM ({_T}) q WHERE {sql}"


attributed("scan_sorted", "SORTED", "timestamp", "timestamp BETWEEN 1_709_560_800_000_000_000 AND 1_709_568_000_000_000_000", '"timestamp" BETWEEN 1709560800000000000 AND 1709568000000000000')
attributed("scan_grouped", "GROUPED", "symbol", "symbol IN (1873, 4849, 3598)", "symbol IN (1873, 4849, 3598)")
attributed("scan_parted", "PARTED", "exchange", "exchange = 'XALP'", "exchange = 'XALP'")


@query("SELECT 'ticks' AS name, count(*) AS \"rows\" FROM trades")
def sql_show_tables(spark, sf_dir):
    return stored(spark, sf_dir).sql("SHOW TABLES")


@query("SELECT * FROM (VALUES ('trade_id', 'bigint'), ('symbol', 'bigint'), ('timestamp', 'bigint'), ('price', 'bigint'), ('volume', 'bigint'), ('exchange', 'string')) AS d(\"column\", type)")
def sql_describe(spark, sf_dir):
    return stored(spark, sf_dir).sql("DESCRIBE ticks")


@query()
def sql_explain(spark, sf_dir):
    return stored(spark, sf_dir).sql("EXPLAIN SELECT symbol, sum(volume) AS v FROM ticks GROUP BY symbol")


@query("SELECT count(*) AS n FROM trades")
def sql_drop(spark, sf_dir):
    engine = stored(spark, sf_dir)
    engine.sql("CREATE TABLE gone (x INT64)")
    engine.sql("DROP TABLE gone")
    engine.sql("DROP TABLE IF EXISTS gone")
    return engine.sql("SELECT count(*) AS n FROM ticks")


@query(f"SELECT symbol, \"timestamp\" // 3600000000000 * 3600000000000 AS bar, CAST(sum(volume) AS BIGINT) AS volume, max(price) AS high, min(price) AS low, count(price) AS n FROM ({_T}) q WHERE price > 0 GROUP BY 1, 2")
def sql_mv_incremental(spark, sf_dir):
    """A view kept up over two batches of the table: the second one alone is read and merged."""
    engine = Engine(spark, folder(spark, "catalog"))
    engine.sql("CREATE TABLE ticks (trade_id INT64, symbol INT64, timestamp TIMESTAMP_NS, price INT64, volume INT64, exchange STRING)")
    rows = ticks(spark, sf_dir)
    first = F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 0
    engine.catalog.append("ticks", rows.where(first))
    engine.sql("""CREATE MATERIALIZED VIEW bars AS SELECT symbol, xbar(timestamp, 3_600_000_000_000) AS bar, sum(volume) AS volume, max(price) AS high,
        min(price) AS low, count(price) AS n FROM ticks WHERE price > 0 GROUP BY symbol, xbar(timestamp, 3_600_000_000_000)""")
    engine.catalog.append("ticks", rows.where(~first))
    return engine.sql("SELECT * FROM bars")


@query('SELECT trade_id, symbol, "timestamp", price, volume, exchange FROM trades')
def source_parquet(spark, sf_dir):
    path = folder(spark, "out")
    files.write_parquet(table(spark, sf_dir, "trades").drop("msg_type"), path, codec="zstd", row_group_bytes=1 << 20)
    return files.read_parquet(spark, path)


@query('SELECT strftime("timestamp", \'%Y-%m-%d-%H\') AS "hour", count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM trades WHERE "timestamp" IS NOT NULL GROUP BY 1')
def source_hours(spark, sf_dir):
    path = folder(spark, "hours")
    files.write_hours(table(spark, sf_dir, "trades").where("timestamp IS NOT NULL"), path, "timestamp", "symbol", files_per_hour=2)
    back = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return back.groupBy(F.col("hour").cast("string").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_arrow(spark, sf_dir):
    held = arrow.to_arrow(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return arrow.from_arrow(spark, held)


@query("SELECT r_regionkey, r_name FROM region")
def source_streaming_session(spark, sf_dir):
    path = folder(spark, "session")
    session = arrow.StreamingSession(spark, "r_regionkey bigint, r_name string", lambda df, n: df.write.parquet(f"{path}/batch={n}"), batch_rows=2)
    session.ingest_iter((r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").collect())
    return spark.read.parquet(path).select("r_regionkey", "r_name")


def _pipe(spark: SparkSession, sf_dir: str) -> Pipeline:
    pipe = Pipeline(spark)
    rows = ticks(spark, sf_dir).where("symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL")
    pipe.ingest_frame(rows.groupBy("symbol", "timestamp").agg(F.max("price").alias("price"), F.max("volume").alias("volume")))
    return pipe


_P = f"SELECT symbol, {NS} AS ts, CAST(max(price) AS DOUBLE) AS price, max(volume) AS volume FROM trades WHERE symbol IS NOT NULL AND \"timestamp\" IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM ({_P}) q GROUP BY 1")
def facade_execute(spark, sf_dir):
    return _pipe(spark, sf_dir).execute("SELECT symbol, count(*) AS n, sum(volume) AS volume FROM trades GROUP BY symbol")


def faced(name: str, f: Callable[[Pipeline, int], DataFrame], sql: str) -> None:
    """A method of the pipeline for the first symbol."""

    def run(spark, sf_dir):
        pipe = _pipe(spark, sf_dir)
        return f(pipe, pipe.ticks().agg(F.min("symbol")).first()[0])

    QUERIES[name], ORACLES[name] = run, f"WITH p AS ({_P}), t AS (SELECT * FROM p WHERE symbol = (SELECT min(symbol) FROM p)) {sql}"


faced("facade_delta", lambda p, x: p.delta(x, "price").select(F.col("timestamp").alias("ts"), "delta"), "SELECT ts, price - lag(price, 1, 0) OVER (ORDER BY ts) AS delta FROM t")
faced("facade_window_agg", lambda p, x: p.window_agg(x, "max", "price", 9).select(F.col("timestamp").alias("ts"), "max"), 'SELECT ts, max(price) OVER (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS "max" FROM t')
faced("facade_xbar", lambda p, x: p.xbar(x, 3_600_000_000_000).select("bar", "open", "high", "low", "close", "volume", "n"), "SELECT ts // 3600000000000 * 3600000000000 AS bar, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM t GROUP BY 1")


def asked(name: str, q: str, sql: str, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A q query, translated and run; trades are one a symbol and instant."""

    def run(spark, sf_dir):
        engine = Engine(spark)
        usable = table(spark, sf_dir, "trades").where("symbol IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL AND volume IS NOT NULL")
        engine.register("trades", usable.groupBy("symbol", "timestamp").agg(F.max("price").alias("price"), F.max("volume").alias("volume")))
        engine.register("quotes", table(spark, sf_dir, "quotes"))
        return after(engine.sql(translate(q)))

    QUERIES[name], ORACLES[name] = run, f"WITH t AS (SELECT symbol, {NS} AS ts, max(price) AS price, max(volume) AS volume FROM trades WHERE symbol IS NOT NULL AND \"timestamp\" IS NOT NULL AND price IS NOT NULL AND volume IS NOT NULL GROUP BY 1, 2) {sql}"


asked("q_select_by", "select n: count i, v: sum volume, h: max price by symbol from trades where price > 0, volume > 10", "SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v, max(price) AS h FROM t WHERE price > 0 AND volume > 10 GROUP BY 1")
asked("q_fby", "select symbol, timestamp, price from trades where price = (max;price) fby symbol", 'SELECT symbol, ts AS "timestamp", price FROM (SELECT *, max(price) OVER (PARTITION BY symbol) AS m FROM t) q WHERE price = m')
asked("q_prev_next", "select symbol, timestamp, p: prev price, n: next price from trades", 'SELECT symbol, ts AS "timestamp", lag(price) OVER w AS p, lead(price) OVER w AS n FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts)')
asked("q_sdev", "select s: sdev price by symbol from trades where symbol < 1000000", "SELECT symbol, round(stddev_samp(price), 4) AS s FROM t GROUP BY 1 HAVING count(*) > 1", lambda df: df.where("s IS NOT NULL").select("symbol", F.round("s", 4).alias("s")))
asked(
    "q_wj",
    "wj[-30000000000 60000000000; `symbol`timestamp; trades; (quotes; (max;`ask); (count;`bid))]",
    f"""SELECT t.symbol, t.ts AS "timestamp", coalesce(max(q.ask), 0) AS ask_max, count(q.bid) AS bid_count FROM t LEFT JOIN (SELECT symbol, {NS} AS us, ask, bid FROM quotes) q
    ON q.symbol = t.symbol AND q.us BETWEEN t.ts - 30000000000 AND t.ts + 60000000000 GROUP BY 1, 2""",
    lambda df: df.select("symbol", "timestamp", "ask_max", "bid_count"),
)


@query(f"SELECT CAST(trade_id AS VARCHAR) AS memory_id, 't' || (symbol % 3) AS tenant_id, max(price) AS content FROM trades WHERE symbol IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2")
def mem_put(spark, sf_dir):
    """Records put twice: the later write of an id stands."""
    t = table(spark, sf_dir, "trades").where("symbol IS NOT NULL AND price IS NOT NULL").groupBy("trade_id", "symbol").agg(F.max("price").alias("price"))
    old = _records(t, F.lit(0))
    new = _records(t, F.col("price"))
    put = store.put(store.put(spark.createDataFrame([], store.RECORD), old), new)
    return put.select("memory_id", "tenant_id", F.col("content").cast("bigint").alias("content"))


def _records(t: DataFrame, content) -> DataFrame:
    text = lambda v: F.lit(v).cast("string")
    return t.select(
        F.col("trade_id").cast("string").alias("memory_id"), F.concat(F.lit("t"), F.col("symbol") % 3).alias("tenant_id"), text("").alias("namespace_id"),
        text(None).alias("user_id"), text(None).alias("session_id"), text(None).alias("agent_id"), text("note").alias("type"), content.cast("string").alias("content"),
        text(None).alias("metadata_json"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(0).cast("bigint").alias("token_count"), F.lit(1).cast("bigint").alias("created_at_ns"),
        F.lit(0).cast("bigint").alias("last_accessed_ns"), (F.col("trade_id") % 2).cast("bigint").alias("expires_at_ns"), F.lit(0).cast("bigint").alias("access_count"),
        F.lit(0.5).alias("importance"), F.lit(False).alias("pinned"),
    )


@query("SELECT CAST(trade_id AS VARCHAR) AS memory_id FROM trades WHERE symbol IS NOT NULL AND trade_id % 2 = 0 AND symbol % 3 = 1 GROUP BY trade_id, symbol")
def mem_visible(spark, sf_dir):
    t = table(spark, sf_dir, "trades").where("symbol IS NOT NULL").select("trade_id", "symbol").distinct()
    return store.visible(_records(t, F.lit("x")), 10, tenant_id="t1").select("memory_id")


@query("SELECT CAST(trade_id AS VARCHAR) AS memory_id, 't' || (symbol % 3) AS tenant_id, CASE WHEN symbol % 3 = 1 THEN 1 ELSE 0 END AS access_count FROM trades WHERE symbol IS NOT NULL GROUP BY trade_id, symbol")
def mem_touch_save_load(spark, sf_dir):
    t = table(spark, sf_dir, "trades").where("symbol IS NOT NULL").select("trade_id", "symbol").distinct()
    records = _records(t, F.lit("x"))
    path = folder(spark, "memory")
    store.save(store.touched(records, records.where("tenant_id = 't1'"), 5), path)
    return store.load(spark, path).select("memory_id", "tenant_id", F.col("access_count").cast("int").alias("access_count"))
