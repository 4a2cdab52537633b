"""Tables as versioned Parquet folders: DDL, DML by copy on write, time to live and storage tiers.

A table is a folder of versions and a pointer file; a change writes a new version and replaces the pointer by renaming, so readers
see one version or the other, and no statement overwrites what it reads. The version before the current one is kept for
readers that began with it; older ones are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.storage import observed

# Spellings of column types.
TYPES = {
    "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT64": T.LongType(), "BIGINT": T.LongType(), "LONG": T.LongType(),
    "FLOAT32": T.FloatType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "FLOAT64": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.LongType(), "TIMESTAMP_NS": T.LongType(), "SYMBOL": T.StringType(), "STRING": T.StringType(), "VARCHAR": T.StringType(),
    "TEXT": T.StringType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
}
ATTRIBUTES = ("SORTED", "GROUPED", "PARTED")


def type_of(name: str) -> T.DataType:
    try:
        return TYPES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def checked(value: Any, kind: T.DataType, column: str) -> Any:
    """The value as the column stores it; raises on a wrong type or an integer out of range."""
    if value is None:
        return None
    if isinstance(kind, (T.IntegerType, T.LongType)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{column}: an integer is needed, not {value!r}")
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        if not -(2**bits) <= value < 2**bits:
            raise ValueError(f"{column}: {value} is out of range")
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{column}: a number is needed, not {value!r}")
        return float(value)
    if isinstance(kind, T.BooleanType):
        if value not in (True, False, 0, 1):
            raise ValueError(f"{column}: a boolean is needed, not {value!r}")
        return bool(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        raise ValueError(f"{column}: a string is needed, not {value!r}")
    return value


def insert_rows(df: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """df with rows appended; columns left out are NULL, unknown ones and wrong types raise."""
    fields = {f.name: f.dataType for f in df.schema}
    data = []
    for row in rows:
        if unknown := set(row) - set(fields):
            raise ValueError(f"unknown columns {sorted(unknown)}")
        data.append(tuple(checked(row.get(c), kind, c) for c, kind in fields.items()))
    new = df.sparkSession.createDataFrame(data, T.StructType([T.StructField(c, kind) for c, kind in fields.items()]))
    return df.unionByName(new)


def _condition(where: str | Column | None) -> Column:
    cond = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    return F.coalesce(cond, F.lit(False))


def updated(df: DataFrame, where: str | Column | None, values: dict[str, str]) -> DataFrame:
    """df with columns set (to SQL expressions over the old row) where the condition is true."""
    kinds = dict(df.dtypes)
    if unknown := set(values) - set(kinds):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    hit = _condition(where)
    return df.select(*[F.when(hit, F.expr(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def deleted(df: DataFrame, where: str | Column | None) -> DataFrame:
    """df without the rows for which the condition is true."""
    return df.where(~_condition(where))


class Catalog:
    """Named tables below a folder of the session's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # pointer files, through the session's file system
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_table.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, name: str) -> dict[str, Any]:
        path, fs = self._path(name)
        if not fs.exists(path):
            raise ValueError(f"no table {name!r}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, meta: dict[str, Any]) -> None:
        """Writes the pointer beside the old one and renames it over it, which is atomic on file systems that can rename."""
        path, fs = self._path(name)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        new = hadoop.Path(path.getParent(), f"_table-{uuid.uuid4().hex}.tmp")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(meta).encode()))
        finally:
            stream.close()
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, path, over)

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _write(self, name: str, df: DataFrame, meta: dict[str, Any]) -> None:
        version = uuid.uuid4().hex
        out = df
        attributes = meta.get("attributes", {})
        parted = [c for c, a in attributes.items() if a == "PARTED"]
        ordered = [c for c, a in attributes.items() if a == "SORTED"]
        if ordered:
            out = out.sortWithinPartitions(*parted, *ordered)
        writer = out.write
        for c, a in attributes.items():
            if a == "GROUPED":
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if parted:
            writer = writer.partitionBy(*parted)
        writer.parquet(f"{self.root}/{name}/{version}")
        kept = [v for v in (meta.get("version"),) if v]
        self._save(name, {**meta, "version": version, "kept": kept, "schema": out.schema.json()})
        path, fs = self._path(name)
        for old in set(meta.get("kept", ())) - {version, *kept}:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), old), True)

    def create(self, name: str, columns: dict[str, str], if_not_exists: bool = False) -> None:
        if self.exists(name):
            if if_not_exists:
                return
            raise ValueError(f"table {name!r} exists")
        schema = T.StructType([T.StructField(c, type_of(kind)) for c, kind in columns.items()])
        self._write(name, self.spark.createDataFrame([], schema), {"attributes": {}, "types": {c: k.upper() for c, k in columns.items()}})

    def drop(self, name: str, if_exists: bool = False) -> None:
        path, fs = self._path(name)
        if not fs.exists(path):
            if if_exists:
                return
            raise ValueError(f"no table {name!r}")
        fs.delete(path.getParent(), True)

    def table(self, name: str) -> DataFrame:
        meta = self._load(name)
        schema = T.StructType.fromJson(json.loads(meta["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{meta['version']}").select(*schema.names)

    def files(self, name: str) -> list[str]:
        """The data files of the current version."""
        return self.table(name).inputFiles()

    def part(self, name: str, files: Iterable[str]) -> DataFrame:
        """The rows of some of its files."""
        meta = self._load(name)
        schema = T.StructType.fromJson(json.loads(meta["schema"]))
        base = f"{self.root}/{name}/{meta['version']}"
        files = sorted(files)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*files).select(*schema.names) if files else self.table(name).limit(0)

    def insert(self, name: str, rows: list[dict[str, Any]]) -> int:
        new = insert_rows(self.table(name).limit(0), rows)
        return self.append(name, new)

    def append(self, name: str, df: DataFrame) -> int:
        """Adds files to the current version: no row is rewritten."""
        meta = self._load(name)
        schema = T.StructType.fromJson(json.loads(meta["schema"]))
        parted = [c for c, a in meta["attributes"].items() if a == "PARTED"]
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        counted = Observation()
        writer = rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append")
        (writer.partitionBy(*parted) if parted else writer).parquet(f"{self.root}/{name}/{meta['version']}")
        self._save(name, {**meta, "appends": meta.get("appends", 0) + 1})
        return observed(counted, "n")

    def state(self, name: str) -> tuple[str, int]:
        """Changes whenever the table's rows do."""
        meta = self._load(name)
        return meta["version"], meta.get("appends", 0)

    def _rewrite(self, name: str, where: str | None, change: Callable[[DataFrame], DataFrame]) -> int:
        """Writes a new version in one scan, which also counts the rows that the condition holds for."""
        counted = Observation()
        rows = self.table(name).observe(counted, F.coalesce(F.count_if(_condition(where)), F.lit(0)).alias("n"))
        self._write(name, change(rows), self._load(name))
        return observed(counted, "n")

    def update(self, name: str, values: dict[str, str], where: str | None = None) -> int:
        return self._rewrite(name, where, lambda rows: updated(rows, where, values))

    def delete(self, name: str, where: str | None = None) -> int:
        return self._rewrite(name, where, lambda rows: deleted(rows, where))

    def add_column(self, name: str, column: str, kind: str) -> None:
        rows = self.table(name)
        if column in rows.columns:
            raise ValueError(f"column {column!r} exists")
        meta = self._load(name)
        schema = T.StructType.fromJson(json.loads(meta["schema"])).add(T.StructField(column, type_of(kind)))
        self._save(name, {**meta, "schema": schema.json(), "types": {**meta.get("types", {}), column: kind.upper()}})

    def drop_column(self, name: str, column: str) -> None:
        rows = self.table(name)
        if column not in rows.columns:
            raise ValueError(f"no column {column!r}")
        meta = self._load(name)
        meta["attributes"].pop(column, None)
        self._write(name, rows.drop(column), meta)

    def set_attribute(self, name: str, column: str, attribute: str) -> None:
        """SORTED sorts files, GROUPED adds Bloom filters, PARTED partitions by the column."""
        if attribute.upper() not in ATTRIBUTES:
            raise ValueError(f"unknown attribute {attribute!r}")
        rows, meta = self.table(name), self._load(name)
        if column not in rows.columns:
            raise ValueError(f"no column {column!r}")
        meta["attributes"][column] = attribute.upper()
        self._write(name, rows, meta)

    def expire(self, name: str, ts_ns: str, ttl_ns: int, now_ns: int) -> int:
        """Deletes whole hours older than the time to live; returns the rows deleted."""
        hour = 3600 * 10**9
        return self.delete(name, f"{ts_ns} < {(now_ns - ttl_ns) // hour * hour}")

    def set_ttl(self, name: str, ts_ns: str, ttl_ns: int) -> None:
        """Keeps the time to live with the table: ``maintain`` applies it whenever it runs."""
        if ts_ns not in self.table(name).columns:
            raise ValueError(f"no column {ts_ns!r}")
        self._save(name, {**self._load(name), "ttl": {"ts": ts_ns, "ns": ttl_ns}})

    def maintain(self, now_ns: int) -> dict[str, int]:
        """Deletes what has outlived its table's time to live; rows deleted by table. To be run by a schedule."""
        out = {}
        for name in self.names():
            if ttl := self._load(name).get("ttl"):
                out[name] = self.expire(name, ttl["ts"], ttl["ns"], now_ns)
        return out

    def move_tiers(self, name: str, ts_ns: str, now_ns: int, folders: dict[str, str]) -> dict[str, int]:
        """Moves rows whose age makes them warm or cold out of the table into the tier's folder; rows moved by tier.

        Whole hours are moved. Rows are written under the run's time first and deleted from the table then. The pointer notes a run
        that has begun; one that broke is gone through again with its own time, which replaces what it had written.
        """
        hour = 3600 * 10**9
        meta = self._load(name)
        now_ns = meta.setdefault("moving", now_ns)
        self._save(name, meta)
        policy, out = meta.get("policy", {}), {}
        cuts = {t: (now_ns - policy[t]) // hour * hour for t in ("warm", "cold", "drop") if policy.get(t) is not None}
        for tier, older in (("warm", ("cold", "drop")), ("cold", ("drop",))):
            if tier not in cuts or tier not in folders:
                continue
            low = max((cuts[o] for o in older if o in cuts), default=-(2**63))
            rows = self.table(name).where((F.col(ts_ns) < cuts[tier]) & (F.col(ts_ns) >= low))
            counted = Observation()
            rows = rows.withColumn("hour_", F.expr(f"`{ts_ns}` div {hour}")).withColumn("run_", F.lit(now_ns)).observe(counted, F.count(F.lit(1)).alias("n"))
            writer = rows.repartition("hour_").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            writer.partitionBy("hour_", "run_").parquet(folders[tier])
            out[tier] = observed(counted, "n")
        if gone := [cuts[t] for t in (*out, "drop") if t in cuts]:
            self.delete(name, f"`{ts_ns}` < {max(gone)}")
        self._save(name, {k: v for k, v in self._load(name).items() if k != "moving"})
        return out

    def set_policy(self, name: str, warm_ns: int | None = None, cold_ns: int | None = None, drop_ns: int | None = None) -> None:
        """Ages from which rows are warm, cold and dropped; None for never."""
        ages = [a for a in (warm_ns, cold_ns, drop_ns) if a is not None]
        if ages != sorted(ages):
            raise ValueError("warm, cold and drop must come in this order")
        self._save(name, {**self._load(name), "policy": {"warm": warm_ns, "cold": cold_ns, "drop": drop_ns}})

    def apply_policy(self, name: str, ts_ns: str, now_ns: int) -> dict[str, DataFrame]:
        """Drops what is due and gives the rest by tier."""
        policy = self._load(name).get("policy", {})
        if policy.get("drop") is not None:
            self.expire(name, ts_ns, policy["drop"], now_ns)
        never = 2**62
        return self.tiers(name, ts_ns, now_ns, policy.get("warm") or policy.get("cold") or never, policy.get("cold") or never)

    def tiers(self, name: str, ts_ns: str, now_ns: int, warm_ns: int, cold_ns: int) -> dict[str, DataFrame]:
        """The table's rows by age: hot, warm and cold."""
        rows = self.table(name)
        age = F.lit(now_ns) - F.col(ts_ns)
        return {"hot": rows.where(age < warm_ns), "warm": rows.where((age >= warm_ns) & (age < cold_ns)), "cold": rows.where(age >= cold_ns)}

    def names(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [n for n in sorted(names) if self.exists(n)]

    def show(self) -> DataFrame:
        """name and rows of every table."""
        rows = [(n, self.table(n).count()) for n in self.names()]
        return self.spark.createDataFrame(rows, "name string, rows bigint")

    def describe(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self.table(name).dtypes, "column string, type string")
