"""Per-key sequence results without imbalance, by exact offset chunking.

1. Repeated rows are combined (in every task before the shuffle), the rest are range-partitioned by (key, order
   columns) - a busy key spans many partitions, whose number follows the input's size - sorted, and written once in chunks:
   row groups of equal numbers of rows, each row with its partition and position. A chunk is read by one task, whatever its keys.
2. Keys are counted per partition; a prefix sum over a key's partitions gives the exact offset of its rows in
   each of them, and position minus start plus offset numbers every row of a key, 1, 2, 3, ...
3. Every stretch of a key within a chunk is worked on where it lies, in Arrow batches.
4. What reaches back over the start of a stretch is settled from the boundary rows of both sides, which are
   grouped by chunk boundary, so no key is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.time import micros
from tickloom.storage import materialize, partitions_for

#: Offsets are broadcast up to this many rows (24 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_OFFSETS = 200_000
#: Rows of a chunk.
CHUNK_ROWS = 100_000


def sorted_rows(df: DataFrame, key: str, order: list[str], payload: list[str], partitions: int | None = None) -> DataFrame:
    """Rows of non-null key, range-partitioned and sorted by (key, order), each of those once.

    Columns: ``k``, the order columns as ``o0``.. and the payload as ``v0``... Of rows equal in key and order the smallest payload stays.
    """
    names = [f"o{i}" for i in range(len(order))]
    values = [f"v{i}" for i in range(len(payload))]
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"),
        *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)),
        *(F.col(c).alias(n) for c, n in zip(payload, values, strict=True)),
    )
    # copies of a row are combined before any shuffle: a range can't split them, however many there are
    once = rows.groupBy("k", *names).agg(*(F.min(v).alias(v) for v in values)) if values else rows.dropDuplicates()
    return once.repartitionByRange(partitions_for(rows, partitions), "k", *names).sortWithinPartitions("k", *names)


def placed(df: DataFrame, key: str, order: list[str], payload: list[str], partitions: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """sorted_rows, written once in chunks, with ``part`` and ``pos``: the row's partition and its position there."""
    ordered = sorted_rows(df, key, order, payload, partitions).withColumn("mid", F.monotonically_increasing_id())
    at = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")
    rows = materialize(ordered, "chunks", group_rows=chunk_rows)
    return rows.select(*rows.columns[:-1], F.shiftright("mid", 33).cast("int").alias("part"), at)


def numbered(df: DataFrame, key: str, order: list[str], payload: list[str], partitions: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of placed numbered exactly within their key by ``order``: ``rn`` is 1, 2, ..."""
    rows = placed(df, key, order, payload, partitions, chunk_rows)
    counts = rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"))
    along = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        counts.select("k", "part", (F.coalesce(F.sum("n").over(along), F.lit(0)) - F.col("start") + 1).alias("shift")), "offsets"
    )
    small = offsets.count() <= MAX_BROADCAST_OFFSETS
    joined = rows.join(F.broadcast(offsets) if small else offsets, ["k", "part"])
    if not small:  # a shuffle join loses the order in which the rows lay
        joined = joined.sortWithinPartitions("k", "part", "pos")
    return joined.select(*rows.columns, (F.col("pos") + F.col("shift")).alias("rn"))


def unusual_values(
    df: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    value: str,
    *,
    before: int = 20,
    factor: float = 10.0,
    chunk_rows: int = CHUNK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Rows whose value is at least ``factor`` times the mean of the ``before`` rows right before it in its key.

    Order is (ts, row_id). Columns: key, row_id, ``rn`` (the row's number in its key), ``value`` and
    ``sum_before`` (the sum of the ``before`` values). A key's first ``before`` rows never come out. Rows with
    a null key, time, id or value, or a value that is not positive, don't take part. A repeated row (same key, time and
    id) counts once, with its smallest value. Values are integers, so sums are exact. Empty input gives no
    rows; other columns are ignored.
    """
    if chunk_rows < before:
        raise ValueError("chunk_rows must be at least the number of rows looked back")
    rows = df.where(F.col(ts).isNotNull() & F.col(row_id).isNotNull() & (F.col(value) > 0)).select(
        F.col(key), micros(F.col(ts)).alias("us_"), F.col(row_id).alias("id_"), F.col(value).cast("bigint").alias("value_")
    )
    seq = numbered(rows, key, ["us_", "id_"], ["value_"], partitions, chunk_rows).select("k", "rn", F.col("o1").alias("id"), F.col("v0").alias("v"))
    extra = (("s", T.LongType()), ("kind", T.ByteType()), ("block", T.LongType()))
    out = T.StructType([*seq.schema.fields, *(T.StructField(c, t) for c, t in extra)])
    told = seq.mapInArrow(lambda batches: _stretches(batches, before, factor, chunk_rows), out)
    back = Window.partitionBy("k", "block").orderBy("rn").rangeBetween(-before, -1)
    edge = F.when(F.col("kind") != HIT, F.col("v"))
    merged = told.select("k", "rn", "id", "v", "kind", "s", F.sum(edge).over(back).alias("before"), F.count(edge).over(back).alias("c"))
    over = (F.col("c") == before) & (F.col("v") * before >= factor * F.col("before"))
    hits = merged.where((F.col("kind") == HIT) | ((F.col("kind") == HEAD) & over))
    total = F.when(F.col("kind") == HIT, F.col("s")).otherwise(F.col("before"))
    return hits.select(F.col("k").alias(key), F.col("id").alias(row_id), "rn", F.col("v").alias("value"), total.alias("sum_before"))


#: What a row told by a stretch is: a settled hit, one of its first rows, or one of its last rows.
HIT, HEAD, TAIL = 0, 1, 2


def _stretches(batches: Iterator[pa.RecordBatch], before: int, factor: float, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Hits that a stretch settles by itself, and its first and last ``before`` rows, with the chunk they belong to.

    A stretch is a run of rows in one batch with one key, one chunk and consecutive numbers. The last rows of a
    chunk are told once more for the chunk that starts after them.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        k = batch.column("k").to_numpy(zero_copy_only=False)
        rn, v = batch.column("rn").to_numpy(), batch.column("v").to_numpy()
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | (rn[1:] != rn[:-1] + 1) | ((rn[1:] - 1) % chunk_rows == 0)
        first = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        since = np.arange(n) - first[at]
        left = np.append(first[1:], n)[at] - 1 - np.arange(n)
        total = np.concatenate([[0], np.cumsum(v)])
        s = np.zeros(n, np.int64)
        inner = np.flatnonzero(since >= before)
        s[inner] = total[inner] - total[inner - before]
        hit = np.zeros(n, bool)
        hit[inner] = v[inner] * before >= factor * s[inner]
        head, tail = since < before, left < before
        block = (rn - 1) // chunk_rows
        ahead = (head | tail) & ((rn - 1) % chunk_rows >= chunk_rows - before)
        for rows, kind, later in ((hit, HIT, 0), (head, HEAD, 0), (tail & ~head, TAIL, 0), (ahead, TAIL, 1)):
            take = np.flatnonzero(rows)
            if len(take):
                told = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [*told.columns, pa.array(s[take]), pa.array(np.full(len(take), kind, np.int8)), pa.array(block[take] + later)],
                    names=["k", "rn", "id", "v", "s", "kind", "block"],
                )
