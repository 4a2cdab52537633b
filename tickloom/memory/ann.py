"""Approximate nearest neighbours by inverted lists: candidates from the closest centroids, then exact ranking.

Centroids are fitted on a bounded sample (``sample_rows``, documented parameter), their number grows with the square root of the rows;
every row is indexed. How many lists a query probes is set on a bounded sample of the queries (``tuned``), whose exact neighbours
among all rows are looked up: as many as hold the wanted share of them. Lists of any length are scanned by as many tasks as they
fill; every task keeps a query's best k before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.memory import exact


def fit_centroids(df: DataFrame, vector: str, lists: int, *, sample_rows: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means over at most ``sample_rows`` rows, chosen by a hash of the vector."""
    sample = df.where(F.size(vector) > 0).select(vector).orderBy(F.xxhash64(F.col(vector).cast("string"))).limit(sample_rows)
    x = np.array([r[0] for r in sample.toLocalIterator()], float)
    if not len(x):
        return np.empty((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (mine := x[near == j]).size:
                m = mine.sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def assigned(df: DataFrame, vector: str, centroids: np.ndarray, probes: int = 1, name: str = "list_") -> DataFrame:
    """Rows with the list they belong to (``probes`` = 1) or one row for each of the closest lists."""

    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack([np.asarray(v, float) for v in s]) if len(s) else np.empty((0, centroids.shape[1]))
            order = np.argsort(-(x @ centroids.T), axis=1)[:, :probes]
            yield pd.Series([row.tolist() for row in order])

    udf = F.pandas_udf(near, "array<int>")
    return df.where(F.size(vector) > 0).withColumn(name, F.explode(udf(F.col(vector))))


def lists_for(rows: int) -> int:
    """Four times the square root of the rows, from 16 to 4,096."""
    return max(16, min(4096, int(4 * rows**0.5)))


def probes_for(df: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int, centroids: np.ndarray, recall: float, tuned: int) -> int:
    """The fewest lists in which ``tuned`` queries, chosen by a hash of their id, find the wanted share of their exact neighbours."""
    sample = queries.where(F.size(vector) > 0).orderBy(F.xxhash64(query_id), query_id).limit(tuned)
    asked = {r[0]: np.asarray(r[1], float) for r in sample.select(query_id, vector).collect()}
    if not asked:
        return 1
    true = exact.nearest(df.where(F.size(vector) > 0), sample, row_id, query_id, vector, k).join(df.select(F.col(row_id), vector), row_id).select(query_id, vector).collect()
    turns = []
    for q, v in true:
        own = int((np.asarray(v, float) @ centroids.T).argmax())
        turns.append(int((asked[q] @ centroids.T > (asked[q] @ centroids.T)[own]).sum()) + 1)
    return int(np.ceil(np.quantile(turns, recall)))


def nearest(
    df: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int, *,
    lists: int | None = None, probes: int | None = None, recall: float = 0.95, tuned: int = 64,
) -> DataFrame:
    """The k rows of greatest cosine for each query, from its ``probes`` closest lists: query_id, row_id, similarity, rank.

    By default there are ``lists_for`` the rows lists, and ``probes`` is set so that ``tuned`` of the queries find the share
    ``recall`` of their exact neighbours: vectors with little structure need half of the lists and more, those with clusters few.
    Ids are integers.
    """
    centroids = fit_centroids(df, vector, lists or lists_for(df.count()))
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"{query_id} bigint, {row_id} bigint, similarity double, rank int")
    probes = probes or probes_for(df, queries, row_id, query_id, vector, k, centroids, recall, tuned)
    index = assigned(df.select(row_id, vector), vector, centroids)
    asked = assigned(queries.select(query_id, F.col(vector).alias("q_")), "q_", centroids, probes)
    unit = F.pandas_udf(_cosines, "double")
    pairs = index.join(asked, "list_").select(query_id, row_id, unit(F.col(vector), F.col("q_")).alias("similarity"))
    # the limit on the rank lets every task keep its own best k before the shuffle
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), row_id)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.stack([np.asarray(v, float) for v in s]) for s in (a, b))
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.where(norm > 0, (x * y).sum(1) / np.where(norm > 0, norm, 1), 0.0))
