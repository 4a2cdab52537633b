"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. A short word is merged on a contiguous array: its part
boundaries and, beside them, the rank of each pair of adjacent parts. The least rank is found by scanning, the boundary
in the middle of its pair is deleted, and the ranks of the two pairs it touched are looked up again. A long
word, where scanning again and again would be quadratic, is merged with a heap over linked parts; both give the same
ids. Words met before come from a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern that cuts texts into words for the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of more bytes are merged with a heap.
SHORT_WORD = 96
#: Words kept per worker, and the longest word (in characters) that is kept.
CACHED_WORDS, CACHED_LENGTH = 400_000, 48
NO_RANK = 1 << 31


class ByteBpe:
    """Encoder over ranks: bytes of each token to its id, lower ids merging first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, word: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(word)) is not None:
            return (whole,)
        return self.short(word) if len(word) <= SHORT_WORD else self.long(word)

    def short(self, word: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == NO_RANK:
                break
            i = pairs.index(least)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(word[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return tuple(self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))

    def long(self, word: bytes) -> tuple[int, ...]:
        n, rank = len(word), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue  # one of the two parts has changed since
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
                if (r := rank(word[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, end[stop]))
            if (p := before[a]) >= 0 and (r := rank(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(self.ranks[word[i : end[i]]] for i in range(n) if end[i])

    def encode_into(self, text: str, out: array) -> None:
        cache = self.cache
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "replace"))
                if len(w) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[w] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The worker's encoder for a rank file: lines of a base64 token and its id."""
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(token): int(n) for token, n in map(bytes.split, lines)})


def encode_batches(texts: pa.ChunkedArray | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of an Arrow column of texts; null and empty texts have none."""
    bpe, out = encoder(path), array("i")
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, raw in enumerate(texts.cast(pa.binary())):
        if (raw := raw.as_py()) is not None:
            bpe.encode_into(raw.decode("utf-8", "replace"), out)
        offsets[i + 1] = len(out)
    return offsets, np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32)


def token_ids(df: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """The token ids of every text, without special tokens; their strings in a text are plain text.

    One row per input row, repeated rows too; null and empty texts give an empty list. Bytes that are no UTF-8 count as U+FFFD. The
    rank file must be readable at ``path`` on every executor. Columns: doc_id and ``ids``.
    """
    rows = df.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = T.StructType([rows.schema["d"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                offsets, flat = encode_batches(batch.column("t"), path)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("d"), lists], names=["d", "ids"])

    return rows.mapInArrow(encode, out).select(F.col("d").alias(doc_id), F.col("ids").alias(ids))
