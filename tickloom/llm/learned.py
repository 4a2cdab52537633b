"""Context windows scored by weights that are learned from reviewers' marks.

A window (a sentence or line) is the set of its words and of its pairs of neighbouring words. A document is as bad as
its worst window, so the marks of whole documents teach weights of words and pairs: the gradient of a document's mark goes to
its worst window only. Reviewers err, so a mark is taken to be wrong with a fixed probability. The weights are shrunk, and how far
is put right on documents they weren't learned from: each half of the sample is scored by the weights of the other one, and scale and
shift are fitted to those scores.

Everything is learned from a bounded sample: ``rows`` documents at most, chosen by a hash of their id, and ``features`` words and
pairs at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.storage import materialize

#: Documents and features that are learned from, at most.
SAMPLE_ROWS, FEATURES = 20_000, 50_000
#: Share of the marks that are wrong.
WRONG = 0.04
#: Documents (marked positive, and of any mark) that a feature must occur in, and how much likelier a mark it must go with.
LEAST_POSITIVE, LEAST, LIFT = 2, 3, 2.0
SHRINK, ROUNDS, RATE = 1.0, 150, 0.1
#: Weight from which a word is looked for in its misspellings too, and its least letters.
TERM_WEIGHT, TERM_LETTERS = 0.3, 5
START, END = "^", "$"


def features(words: list[str]) -> set[str]:
    """The words of a window and its pairs of neighbours."""
    line = [START, *words, END]
    return {*words, *(f"{a} {b}" for a, b in zip(line, line[1:], strict=False))}


@dataclass
class Weights:
    """Weights of words and of pairs, with what turns a sum of them into a probability."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, dict[str, float]] = field(default_factory=dict)
    bias: float = -9.0
    scale: float = 1.0
    shift: float = 0.0
    #: Words of documents that were marked harmless, which stand for themselves.
    known: frozenset[str] = frozenset()

    @property
    def terms(self) -> list[str]:
        return [w for w, x in self.words.items() if x >= TERM_WEIGHT and len(w) >= TERM_LETTERS and w.isalpha()]

    def probability(self, total: float) -> float:
        """Probability that a window is abusive whose words and pairs weigh so much."""
        return 1 / (1 + exp(-(self.scale * (self.bias + total) + self.shift)))


def _rise(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slope of the likelihood of ``y`` positive ones of ``n`` marks in a document's logit."""
    p = 1 / (1 + np.exp(-z))
    q = p * (1 - WRONG) + (1 - p) * WRONG
    return (y / q - (n - y) / (1 - q)) * (1 - 2 * WRONG) * p * (1 - p)


class _Climb:
    """Steps of a size that adapts to each parameter."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.m, self.v, self.t = x, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, slope: np.ndarray) -> None:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * slope, 0.99 * self.v + 0.01 * slope * slope
        self.x += RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


@dataclass
class _Windows:
    """Windows of documents as one array of feature numbers."""

    doc: np.ndarray  # of each window, ascending
    size: np.ndarray
    flat: np.ndarray

    def occurrences(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which document holds which feature, each once."""
        held = np.sort(np.repeat(self.doc, self.size) * size + self.flat)
        held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
        return held // size, held % size

    def of(self, docs: np.ndarray, used: np.ndarray) -> _Windows:
        """Those of some documents (a mask), with the used features (a mask) only."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        keep = docs[self.doc][row] & used[self.flat]
        size = np.bincount(row[keep], minlength=len(self.size))
        return _Windows(self.doc[size > 0], size[size > 0], self.flat[keep])

    def worst(self, w: np.ndarray, bias: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's greatest sum, which windows have it, and each window's place."""
        z = np.full(n, bias)
        if not len(self.size):
            return z, np.empty(0, bool), np.empty(0, np.int64)
        sums = bias + np.add.reduceat(w[self.flat], np.concatenate([[0], np.cumsum(self.size)[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))
        z[self.doc[first]] = np.maximum.reduceat(sums, first)
        return z, sums == z[self.doc], np.repeat(np.arange(len(self.size)), self.size)


def _learn(windows: _Windows, y: np.ndarray, n: np.ndarray, mine: np.ndarray, size: int) -> tuple[np.ndarray, float, _Windows]:
    """Weights of the features, and the bias, from the documents of a mask."""
    doc, feature = windows.occurrences(size)
    positive = 2 * y > n
    df = np.bincount(feature[mine[doc]], minlength=size)
    dfp = np.bincount(feature[(mine & positive)[doc]], minlength=size)
    base = positive[mine].mean() if mine.any() else 0
    used = (df >= LEAST) & (dfp >= LEAST_POSITIVE) & (dfp > LIFT * base * df)
    own = windows.of(mine, used)
    x = _Climb(np.concatenate([np.zeros(size), [-3.0]]))
    for _ in range(ROUNDS):
        z, worst, row = own.worst(x.x[:-1], x.x[-1], len(y))
        slope = np.where(mine, _rise(z, y, n), 0.0)
        w = np.bincount(own.flat, (slope[own.doc] * worst)[row], minlength=size) if len(own.flat) else np.zeros(size)
        x.step(np.concatenate([w - SHRINK * x.x[:-1], [slope.sum()]]))
    return np.where(used, x.x[:-1], 0.0), float(x.x[-1]), windows.of(np.ones(len(y), bool), used)


def _scaled(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of sums that the documents' own marks had no part in; 1 and 0 without documents."""
    x = _Climb(np.zeros(2))  # logarithm of the scale, shift
    for _ in range(300):
        slope = _rise(np.exp(x.x[0]) * z + x.x[1], y, n)
        x.step(np.array([(slope * z).sum() * np.exp(x.x[0]) - 5 * x.x[0], slope.sum() - x.x[1]]))
    return float(np.exp(x.x[0])), float(x.x[1])


def learn(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, mark: str, split: Callable[[str], Iterator[list[str]]], rows: int = SAMPLE_ROWS) -> Weights | None:
    """Weights from the marks (1 or 0; null ones don't count) of at most ``rows`` documents; None without any positive one.

    ``split`` gives the words of each window of a text. Documents without text teach nothing; an id that occurs several times counts once.
    """
    given = F.col(mark).cast("bigint")
    marks = labels.where(given.isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.sum(given).alias("y"), F.count(F.lit(1)).alias("n"))
    sample = marks.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where(F.length("t") > 0)
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.join(F.broadcast(sample), "doc").repartition(tasks, "doc").groupBy("doc", "y", "n").agg(F.min("t").alias("t"))
    texts = texts.select(F.xxhash64("doc").alias("h"), "y", "n", "t")
    words = T.ArrayType(T.StringType())
    told = T.StructType([*texts.schema.fields[:3], T.StructField("windows", T.ArrayType(words)), T.StructField("f", words)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(split(raw.decode("utf-8", "replace"))) for raw in batch.column("t").cast(pa.binary()).to_pylist()]
            positive = (2 * batch.column("y").to_numpy() > batch.column("n").to_numpy()).tolist()
            # pairs are learned from documents marked positive only, so those of others needn't be counted
            each = [list(set().union(*map(features if p else set, doc))) for p, doc in zip(positive, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.list_(pa.string()))), pa.array(each, pa.list_(pa.string()))], names=["h", "y", "n", "windows", "f"])

    windows = materialize(texts.mapInArrow(cut, told), "windows")
    positive = F.expr("2 * y > n")
    each = windows.select(positive.alias("p"), F.explode("f").alias("f"))
    counts = each.groupBy("f").agg(F.count_if("p").alias("p"), F.count_if(~F.col("p")).alias("q"))
    counts = materialize(counts.where((F.col("p") >= LEAST_POSITIVE) | (F.col("q") >= LEAST_POSITIVE)), "features")
    share = windows.agg(F.avg(positive.cast("double"))).first()[0] or 0.0
    # a half of the sample may ask for a little more or less than all of it
    likely = (F.col("p") >= LEAST_POSITIVE) & (F.col("p") > 0.75 * LIFT * share * (F.col("p") + F.col("q")))
    chosen = sorted(r["f"] for r in counts.where(likely).orderBy(F.desc("p"), "f").limit(FEATURES).collect())
    if not chosen:
        return None
    number = {f: k for k, f in enumerate(chosen)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[hit for window in doc if (hit := sorted(number[f] for f in features(window) if f in number))] for doc in batch.column("windows").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["h", "y", "n", "windows"])

    table = windows.drop("f").mapInArrow(numbered, "h bigint, y bigint, n bigint, windows array<array<int>>").toArrow().sort_by("h")
    y, n = (table.column(c).to_numpy().astype(float) for c in ("y", "n"))
    nested = table.column("windows").combine_chunks()
    inner = nested.flatten()
    size = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    held = _Windows(np.repeat(np.arange(len(y)), nested.value_lengths().to_numpy(zero_copy_only=False)), size, inner.flatten().to_numpy(zero_copy_only=False))

    z, half = np.empty(len(y)), table.column("h").to_numpy() % 2 == 0
    for mine in (half, ~half):
        w, bias, all_ = _learn(held, y, n, mine, len(chosen))
        z[~mine] = all_.worst(w, bias, len(y))[0][~mine]
    scale, shift = _scaled(z, y, n)
    w, bias, _ = _learn(held, y, n, np.ones(len(y), bool), len(chosen))
    weights = Weights(bias=bias, scale=scale, shift=shift)
    for k in np.flatnonzero(w).tolist():
        a, _, b = chosen[k].partition(" ")
        if b:
            weights.pairs.setdefault(a, {})[b] = float(w[k])
        else:
            weights.words[a] = float(w[k])
    harmless = counts.where((F.col("q") >= LEAST_POSITIVE) & ~F.contains(F.col("f"), F.lit(" ")) & (F.col("p") <= F.col("q"))).orderBy(F.desc("q"), "f").limit(FEATURES)
    weights.known = frozenset(r["f"] for r in harmless.collect())
    return weights
