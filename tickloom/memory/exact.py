"""Exact nearest rows of a stated set of queries, against all rows, in blocks.

Queries are taken to the driver and sent out a block at a time (``block`` vectors at most); every task multiplies
its rows by the block and keeps each query's best k, which alone are shuffled. No pair of a row and a query becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
#: Rows multiplied at once, so that a product of a block stays below 10 MB.
ROWS = 1024
#: Digits to which similarities are compared; sums in another order differ beyond them.
DIGITS = 12


def unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of unit length; zero for missing, empty, zero and shorter or longer vectors."""
    out = np.zeros((len(column), size))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy()
    fits = np.flatnonzero(lengths == size) if size else np.empty(0, np.int64)
    if len(fits):
        flat = column.take(pa.array(fits)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
        out[fits] = np.nan_to_num(flat.reshape(len(fits), size))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def nearest(df: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int, *, others: bool = False, block: int = BLOCK) -> DataFrame:
    """The k rows of greatest cosine for each query: query_id, row_id, ``similarity``, ``rank`` (equals by row id).

    With ``others`` a row isn't compared with the query of its own id. Ids are integers and not null. A vector that is missing, empty or
    zero, or of another size than the query's, has similarity 0. Either table may be empty; other columns are ignored.
    """
    schema = T.StructType([T.StructField(c, t) for c, t in ((query_id, T.LongType()), (row_id, T.LongType()), ("similarity", T.DoubleType()))])
    parts, held = [], []
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    for q in queries.select(F.col(query_id).cast("bigint"), vector).toLocalIterator():
        held.append((q[0], q[1] or []))
        if len(held) == block:
            parts.append(rows.mapInArrow(_multiplied(held, k, others, schema.names), schema))
            held = []
    if held or not parts:
        parts.append(rows.mapInArrow(_multiplied(held, k, others, schema.names), schema))
    near = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), row_id)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _multiplied(queries: list[tuple[int, list[float]]], k: int, others: bool, names: list[str]):
    ids = np.array([i for i, _ in queries], np.int64)
    sizes = np.array([len(v) for _, v in queries], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_id = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        blocks = {n: unit(pa.array([v for _, v in queries if len(v) == n], pa.list_(pa.float64())), n) for n in set(sizes.tolist())}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row = part.column("id").to_numpy()
                s = np.zeros((len(ids), len(row)))
                for n, block in blocks.items():
                    s[sizes == n] = block @ unit(part.column("v"), n).T
                s = np.round(s, DIGITS)
                if others:
                    s[ids[:, None] == row[None, :]] = -np.inf
                both_s, both_id = np.concatenate([best_s, s], axis=1), np.concatenate([best_id, np.broadcast_to(row, s.shape)], axis=1)
                order = np.lexsort((both_id, -both_s), axis=1)[:, :k]
                best_s, best_id = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_id, order, 1)
        told = np.isfinite(best_s)
        asked = np.broadcast_to(ids[:, None], best_s.shape)
        yield pa.RecordBatch.from_arrays([pa.array(asked[told]), pa.array(best_id[told]), pa.array(best_s[told])], names=names)

    return run
