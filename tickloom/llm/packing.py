"""Fixed-capacity containers filled with items that are neighbours along a space-filling curve.

Each document's token counts, hashed into buckets, are projected to three dimensions; the point's Hilbert key
orders the documents so that similar ones lie together. Documents are range-partitioned and sorted by that key
(then by id, so that copies of one text can be spread) and every stretch of the curve is packed by itself: a short window
moves along it, its documents go by decreasing size into the container with the least sufficient room, and a container is closed
once the window has moved on by so many documents. So what shares a container lies close together on the curve.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.tokens import BYTE_BPE_50K, encode_batches
from tickloom.storage import materialize

BUCKETS, DIMENSIONS, KEY_BITS = 1 << 12, 3, 16
#: Documents of a stretch of the curve, which one task packs; only its last containers stay partly empty.
STRETCH_ROWS = 50_000
#: Documents of a window, and documents along the curve for which a container stays open.
WINDOW, REACH = 128, 1024
# A rational approximation of the error function (its error is below 2e-7).
ERF_SCALE, ERF_TERMS = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def projections(seed: int = 7) -> np.ndarray:
    """Random directions of the buckets."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def normal_share(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution below z."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + ERF_SCALE * x)
    tail = np.polyval([*ERF_TERMS, 0.0], t) * np.exp(-x * x)
    return np.where(z > 0, 1 - tail / 2, tail / 2)


def hilbert_keys(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows; coordinates of ``bits`` bits each)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    # bring the coordinates into the transposed index, from the highest bit down
    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        for d in range(dims):
            upper = (x[d] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] ^= np.where(upper, q - 1, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def curve_keys(offsets: np.ndarray, ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as token ids; documents without tokens have key 0."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (ids.astype(np.int64) * 2654435761 >> 7) & (BUCKETS - 1)
    cell, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    weight, row = np.sqrt(count), cell // BUCKETS
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    point = np.stack([np.bincount(row, weight * directions[cell % BUCKETS, d], minlength=n) for d in range(DIMENSIONS)])
    z = point / np.where(norm > 0, norm, 1)
    grid = np.minimum((normal_share(z) * (1 << KEY_BITS)).astype(np.int64), (1 << KEY_BITS) - 1)
    return np.where(norm > 0, hilbert_keys(grid.T), 0)


def sized(df: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """doc, its number of tokens ``n`` and its Hilbert key ``h``, one row per input row."""
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    out = T.StructType([rows.schema["doc"], T.StructField("n", T.LongType()), T.StructField("h", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = projections()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                offsets, ids = encode_batches(batch.column("t"), path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(np.diff(offsets)), pa.array(curve_keys(offsets, ids, directions))], names=["doc", "n", "h"]
                )

    return rows.mapInArrow(measure, out)


class Packer:
    """Best fit by decreasing size within each window; a container closes ``reach`` documents after it was opened."""

    def __init__(self, capacity: int, reach: int = REACH) -> None:
        self.capacity, self.reach = capacity, reach
        self.room: list[tuple[int, int, int]] = []  # (free, container, document by which it closes), ascending
        self.made = self.seen = 0

    def place(self, sizes: list[int], documents: int) -> list[int]:
        """Container of each item of a window of so many documents, none of the items larger than the capacity."""
        self.room = [r for r in self.room if r[2] > self.seen]
        where = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
            size = sizes[i]
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                free, box, closes = self.room.pop(at)
            else:
                free, box, closes = self.capacity, self.made, self.seen + self.reach
                self.made += 1
            where[i] = box
            if free > size:
                insort(self.room, (free - size, box, closes))
        self.seen += documents
        return where


def pack(
    df: DataFrame,
    doc_id: str,
    text: str,
    *,
    capacity: int = 2048,
    window: int = WINDOW,
    reach: int = REACH,
    path: str = BYTE_BPE_50K,
    partitions: int | None = None,
) -> DataFrame:
    """The pieces of every document with the containers they go into.

    Columns: doc_id, ``doc_tokens``, ``piece`` (0, 1, ...), ``start`` (the piece's first token), ``n_tokens`` and
    ``container``. Only a document of more than ``capacity`` tokens has several pieces: full containers and
    a remainder, which is packed like any other item. Documents without tokens have one piece without container
    (null), so every input row comes out. No container holds more than ``capacity``. Container numbers are unique, not
    consecutive. Equal texts under several ids are items of their own; empty input gives no rows.

    A container takes only documents that lie within ``window`` + ``reach`` documents of each other on the curve; then it is closed,
    filled or not. Windows also end where an Arrow batch does, and no container goes on from one stretch of the curve
    (STRETCH_ROWS documents) to the next.
    """
    items = materialize(sized(df, doc_id, text, path), "sizes")
    n = partitions or max(1, -(-items.count() // STRETCH_ROWS))
    curve = items.repartitionByRange(n, "h", "doc").sortWithinPartitions("h", "doc")
    names = ["doc_tokens", "piece", "start", "n_tokens", "container"]
    out = T.StructType([items.schema["doc"], *(T.StructField(c, T.LongType()) for c in names)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity, reach), TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, packer, base, window)

    packed = curve.mapInArrow(fill, out)
    return packed.select(F.col("doc").alias(doc_id), *names)


def _packed(batch: pa.RecordBatch, packer: Packer, base: int, window: int) -> pa.RecordBatch:
    n = batch.column("n").to_numpy()
    pieces = np.maximum(1, -(-n // packer.capacity))
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * packer.capacity
    size = np.minimum(n[doc] - start, packer.capacity)
    some = np.flatnonzero(size > 0)
    box = np.zeros(len(doc), np.int64)
    for at in range(0, len(n), window):
        lo, hi = np.searchsorted(doc[some], (at, at + window))
        mine = some[lo:hi]
        box[mine] = np.array(packer.place(size[mine].tolist(), min(window, len(n) - at)), np.int64) + base
    columns = [batch.column("doc").take(pa.array(doc)), *map(pa.array, (n[doc], piece, start, size)), pa.array(box, mask=size == 0)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "doc_tokens", "piece", "start", "n_tokens", "container"])
