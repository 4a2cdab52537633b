"""Splayed tables of q databases: a folder per table (and date), a file per column, symbols enumerated in a sym file."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types by number, as little-endian arrays behind an 8-byte header whose second byte is the number.
LAYOUTS = {
    1: ("u1", "boolean"), 4: ("u1", "smallint"), 5: ("<i2", "smallint"), 6: ("<i4", "int"), 7: ("<i8", "bigint"), 8: ("<f4", "float"), 9: ("<f8", "double"),
    10: ("S1", "string"), 11: ("<i4", "string"), 12: ("<i8", "bigint"), 13: ("<i4", "int"), 14: ("<i4", "date"), 16: ("<i8", "bigint"), 17: ("<i4", "int"), 18: ("<i4", "int"), 19: ("<i4", "int"),
}
HEADER = 8
#: Timestamps and dates count from 2000-01-01.
EPOCH_NS, EPOCH_DAYS = 946_684_800 * 10**9, 10_957


def symbols(raw: bytes) -> list[str]:
    """Names of a sym file: ended by zero bytes, behind the header if there is one."""
    body = raw[HEADER:] if raw[:1] in (b"\x01", b"\xff") and len(raw) >= HEADER else raw
    return [s.decode("utf-8", "replace") for s in body.split(b"\0")[:-1]]


def column(raw: bytes, names: list[str]) -> tuple[int, pd.Series]:
    """A column file's type and values; the least integer is NULL."""
    kind = raw[1]
    if kind not in LAYOUTS:
        raise ValueError(f"unknown column type {kind}")
    layout, _ = LAYOUTS[kind]
    size = np.dtype(layout).itemsize
    x = np.frombuffer(raw, layout, offset=HEADER, count=(len(raw) - HEADER) // size)
    if kind == 11:
        return kind, pd.Series([names[i] if 0 <= i < len(names) else None for i in x.tolist()], dtype=object)
    if kind == 10:
        return kind, pd.Series([b.decode("latin-1") for b in x.tolist()], dtype=object)
    if kind == 1:
        return kind, pd.Series(x.astype(bool))
    values = pd.Series(x)
    if x.dtype.kind == "i":
        missing = values == np.iinfo(x.dtype).min
        if kind == 12:
            values = values + EPOCH_NS
        if kind == 14:
            values = pd.to_datetime(values.where(~missing, 0) + EPOCH_DAYS, unit="D").dt.date
        values = values.astype(object).where(~missing, None) if missing.any() else values
    return kind, values


def load(spark: SparkSession, root: str, table: str, partitioned: bool = True) -> DataFrame:
    """A splayed table; with ``partitioned`` below one folder per date, which becomes the column ``date_part``.

    Each date's folder is read by one task. Timestamps become nanoseconds since 1970. Types come from one folder's headers.
    """
    sym_path = os.path.join(root, "sym")
    names = symbols(open(sym_path, "rb").read()) if os.path.exists(sym_path) else []
    dates = sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d, table))) if partitioned else [""]
    if not dates:
        raise ValueError(f"no table {table!r} below {root!r}")
    first = os.path.join(root, dates[0], table)
    columns = sorted(c for c in os.listdir(first) if not c.startswith("."))
    kinds = {}
    for c in columns:
        with open(os.path.join(first, c), "rb") as f:
            kinds[c] = f.read(2)[1]
    schema = ", ".join(f"`{c}` {LAYOUTS[k][1]}" for c, k in kinds.items()) + (", date_part string" if partitioned else "")
    shared = spark.sparkContext.broadcast(names)
    pattern = os.path.join(root, "*", table, "[!.]*") if partitioned else os.path.join(root, table, "[!.]*")
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("column"), "content")

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {c: column(bytes(raw), shared.value)[1] for c, raw in zip(pdf["column"], pdf["content"], strict=True)}
        frame = pd.DataFrame({c: out[c] for c in columns})
        if partitioned:
            frame["date_part"] = pdf["folder"].iloc[0].rstrip("/").split("/")[-2]
        return frame

    return files.groupBy("folder").applyInPandas(assemble, schema)
