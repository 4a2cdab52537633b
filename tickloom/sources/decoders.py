"""Decoders of feed messages: rows of text or bytes in, columns out. Text stays in the JVM; bytes go in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 64-byte tick message (little endian; 16 bytes of padding at the end).
TICK = np.dtype(
    {
        "names": ["seq", "recv_ts", "symbol_id", "price", "volume", "msg_type", "price_is_float", "table_id"],
        "formats": ["<u8", "<i8", "<u4", "<i8", "<i8", "u1", "u1", "<u2"],
        "offsets": [0, 8, 16, 24, 32, 40, 41, 42],
        "itemsize": 64,
    }
)
# Field numbers of the FIX protocol.
FIX_TAGS = {"msg_type": 35, "sender": 49, "seq": 34, "symbol": 55, "side": 54, "quantity": 38, "price": 44, "last_price": 31, "last_quantity": 32, "bid": 132, "bid_size": 134, "offer": 133, "offer_size": 135, "order_id": 37}
# Big-endian layouts of order-book messages by type letter, prices in ten-thousandths.
BOOK = {
    b"A": np.dtype([("locate", ">u2"), ("tracking", ">u2"), ("ts", ">u8"), ("order", ">u8"), ("side", "S1"), ("shares", ">u4"), ("stock", "S8"), ("price", ">u4")]),
    b"E": np.dtype([("locate", ">u2"), ("tracking", ">u2"), ("ts", ">u8"), ("order", ">u8"), ("shares", ">u4"), ("match", ">u8")]),
    b"P": np.dtype([("locate", ">u2"), ("tracking", ">u2"), ("ts", ">u8"), ("order", ">u8"), ("side", "S1"), ("shares", ">u4"), ("stock", "S8"), ("price", ">u4"), ("match", ">u8")]),
}


def json_ticks(df: DataFrame, value: str, *, human: bool = False, price_scale: float = 1.0) -> DataFrame:
    """Ticks of JSON messages: symbol_id, price, volume, ts; in the human form a symbol's name and a decimal price.

    Messages that are no JSON or lack a field give NULLs there. Works on streams.
    """
    schema = "symbol string, price double, volume bigint, ts bigint" if human else "symbol_id bigint, price bigint, volume bigint, ts bigint"
    j = F.from_json(F.col(value).cast("string"), schema)
    price = F.round(j["price"] * price_scale).cast("bigint") if human else j["price"]
    return df.select(j["symbol" if human else "symbol_id"].alias("symbol"), price.alias("price"), j["volume"].alias("volume"), j["ts"].alias("ts"))


def binary_ticks(df: DataFrame, value: str) -> DataFrame:
    """Ticks of 64-byte messages; messages of another size are dropped. ``price`` is a double."""
    schema = "seq bigint, recv_ts bigint, symbol bigint, price double, volume bigint, msg_type int, table_id int"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(b for b in batch.column(0).to_pylist() if b is not None and len(b) == TICK.itemsize)
            t = np.frombuffer(raw, TICK)
            price = np.where(t["price_is_float"] == 1, np.ascontiguousarray(t["price"]).view("<f8"), t["price"].astype(float))
            columns = [t["seq"].astype(np.int64), t["recv_ts"], t["symbol_id"].astype(np.int64), price, t["volume"], t["msg_type"].astype(np.int32), t["table_id"].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["seq", "recv_ts", "symbol", "price", "volume", "msg_type", "table_id"])

    return df.select(F.col(value).cast("binary")).mapInArrow(decode, schema)


def fix_fields(message: Column, separator: str = "\x01") -> dict[str, Column]:
    """Columns of a FIX message by name; missing fields are NULL, numbers that don't parse too."""
    tags = F.transform(F.split(message, separator), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v")))

    def last(tag: int) -> Column:
        """The last field with the tag; NULL without one."""
        return F.try_element_at(F.filter(tags, lambda p: p["k"] == str(tag)), F.lit(-1))["v"]

    text = {name: last(tag) for name, tag in FIX_TAGS.items()}
    numbers = {"seq": "bigint", "quantity": "bigint", "last_quantity": "bigint", "bid_size": "bigint", "offer_size": "bigint", "price": "double", "last_price": "double", "bid": "double", "offer": "double"}
    return {name: (c.try_cast(numbers[name]) if name in numbers else c).alias(name) for name, c in text.items()}


def parse_fix(df: DataFrame, value: str, separator: str = "\x01") -> DataFrame:
    return df.select(*fix_fields(F.col(value), separator).values())


def parse_book(df: DataFrame, value: str) -> DataFrame:
    """Order-book packets (length, type, body, one after another): one row per add, execution and trade."""
    schema = "type string, ts bigint, order_ref bigint, side string, shares bigint, stock string, price double"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for packet in batch.column(0).to_pylist():
                at = 0
                while packet is not None and at + 3 <= len(packet):
                    size, kind = int.from_bytes(packet[at : at + 2], "big"), packet[at + 2 : at + 3]
                    body = packet[at + 3 : at + 2 + size]
                    layout = BOOK.get(kind)
                    if layout is not None and len(body) >= layout.itemsize:
                        m = np.frombuffer(body[: layout.itemsize], layout)[0]
                        has = layout.names
                        rows.append((
                            kind.decode(), int(m["ts"]), int(m["order"]), m["side"].decode() if "side" in has else None, int(m["shares"]),
                            m["stock"].decode().strip() if "stock" in has else None, int(m["price"]) / 10_000 if "price" in has else None,
                        ))
                    at += 2 + max(size, 1)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["type", "ts", "order_ref", "side", "shares", "stock", "price"])

    return df.select(F.col(value).cast("binary")).mapInArrow(decode, schema)


def line_metrics(df: DataFrame, value: str, *, symbol_tag: str = "symbol", price_field: str = "value", volume_field: str = "volume", price_scale: float = 1.0, default_volume: int = 1, unit_ns: int = 1) -> DataFrame:
    """Ticks of line-protocol metrics: ``measurement,tag=v field=1.5,volume=3i 1700000000``.

    The symbol is the tag's value or else the measurement. Lines that are empty, comments or lack the price give no row.
    """
    line = F.trim(F.col(value))
    head, fields, stamp = (F.split_part(line, F.lit(" "), F.lit(i)) for i in (1, 2, 3))
    tag = F.regexp_extract(head, rf",{symbol_tag}=([^,]*)", 1)
    price = F.regexp_extract(fields, rf"(?:^|,){price_field}=(-?[0-9.eE+-]+)", 1).try_cast("double")
    volume = F.regexp_extract(fields, rf"(?:^|,){volume_field}=(-?[0-9]+)", 1).try_cast("bigint")
    rows = df.where(~line.startswith("#") & (line != "")).select(
        F.when(tag != "", tag).otherwise(F.split_part(head, F.lit(","), F.lit(1))).alias("symbol"), F.round(price * price_scale).cast("bigint").alias("price"),
        F.coalesce(volume, F.lit(default_volume).cast("bigint")).alias("volume"), (stamp.try_cast("bigint") * unit_ns).alias("ts_ns"),
    )
    return rows.where(F.col("price").isNotNull())


def exchange_trades(df: DataFrame, value: str, *, price_scale: float = 1.0, volume_scale: float = 1.0) -> DataFrame:
    """Trades of a crypto exchange's JSON stream (s, p, q, T in milliseconds, also wrapped in ``data``); others give no row."""
    fields = "s string, p string, q string, T bigint, e string"
    j = F.from_json(F.col(value).cast("string"), f"{fields}, data struct<s: string, p: string, q: string, T: bigint, e: string>")
    at = lambda c: F.coalesce(j["data"][c], j[c])
    rows = df.select(
        at("s").alias("symbol"), F.round(at("p").try_cast("double") * price_scale).cast("bigint").alias("price"),
        F.round(at("q").try_cast("double") * volume_scale).cast("bigint").alias("volume"), (at("T") * 1_000_000).alias("ts_ns"), at("e").alias("e_"),
    )
    return rows.where("e_ = 'trade' AND price IS NOT NULL").drop("e_")


def kafka_stream(spark, servers: str, topic: str, **options: str) -> DataFrame:
    """The messages of a Kafka topic as a stream with a ``value`` column; offsets live in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**options).load()
