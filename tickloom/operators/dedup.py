"""Exactly one row of each message that was delivered at least once, by seen ranges per producer.

A message's identifier that is written by a producer as a sequence (a fixed text around a number without leading
zeros) is kept as disjoint ranges of seen numbers: a number that no range covers is accepted once and merged into
its neighbours' range. A producer's number line is cut into blocks, so that a busy producer is spread over tasks; rows
come sorted by block, and only the ranges of the block at hand are held. Missing identifiers and those written in any other
way are settled by exact keyed lookup: the least row of each key is found by an aggregate that combines before the shuffle, and
rows are told by their own unique id, so that no key, however many rows it has, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.storage import materialize, observed

#: A sequence identifier: a text (which may begin with a short number), a number of at most 18 digits, the rest.
SEQUENCE = r"^([^0-9\x01]*(?:[0-9]{1,6}[^0-9\x01]+)?)([0-9]{1,18})((?:[^0-9\x01][^\x01]*)?)$"
#: Numbers of one block of a producer's number line: 2 to this power.
BLOCK_BITS = 16
#: Ranges that the pass in the input tasks holds before it begins anew; what it misses the second pass finds.
HELD_RANGES = 1 << 16
#: Keys without identifier are broadcast up to this many (some 40 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000

#: How a row's message is told: it stands alone, by ranges, by its odd identifier, by producer and sequence.
ALONE, RANGED, ODD, WITHOUT = 0, 1, 2, 3


class SeenRanges:
    """Disjoint half-open ranges of seen numbers, sorted and merged."""

    def __init__(self) -> None:
        self.lo, self.hi = np.empty(0, np.int64), np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lo, numbers, side="right") - 1
        return (at >= 0) & (numbers < self.hi[np.maximum(at, 0)]) if len(self.lo) else np.zeros(len(numbers), bool)

    def add(self, numbers: np.ndarray) -> None:
        """Merges sorted distinct numbers, none of them covered."""
        cut = np.flatnonzero(np.diff(numbers) != 1) + 1
        lo = np.concatenate([self.lo, numbers[np.concatenate([[0], cut])]])
        hi = np.concatenate([self.hi, numbers[np.concatenate([cut - 1, [len(numbers) - 1]])] + 1])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        joins = np.concatenate([[True], lo[1:] != hi[:-1]])
        starts = np.flatnonzero(joins)
        self.lo, self.hi = lo[starts], hi[np.append(starts[1:], len(hi)) - 1]


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row's block; rows of one block that follow one another have the same."""
    new = np.zeros(batch.num_rows, bool)
    for name in ("node", "series", "block"):
        code = batch.column(name)
        code = code.dictionary_encode().indices.to_numpy() if name != "block" else code.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _kinds(batch: pa.RecordBatch) -> tuple[list[tuple], np.ndarray]:
    """The blocks that a batch holds rows of, and the position there of each row's."""
    node, series = (batch.column(c).dictionary_encode() for c in ("node", "series"))
    blocks, block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
    mixed = (node.indices.to_numpy().astype(np.int64) * len(series.dictionary) + series.indices.to_numpy()) * len(blocks) + block
    _, first, local = np.unique(mixed, return_index=True, return_inverse=True)
    return _blocks(batch, first), local


def _blocks(batch: pa.RecordBatch, rows: np.ndarray | list[int]) -> list[tuple]:
    """Node, series and block of some rows; texts as bytes, which needn't be UTF-8."""
    held = batch.take(pa.array(rows))
    return list(zip(*(held.column(c).cast(pa.binary()).to_pylist() for c in ("node", "series")), held.column("block").to_pylist(), strict=True))


def _first_of(seen: SeenRanges, number: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which rows are the first of a number that no range covers; their numbers are covered then."""
    order = np.lexsort((row, number))
    first = np.ones(len(number), bool)
    first[order[1:]] = number[order[1:]] != number[order[:-1]]
    fresh = first & ~seen.covers(number)
    if fresh.any():
        seen.add(np.sort(number[fresh]))
    return fresh


def _marked(batch: pa.RecordBatch, dup: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dup)], schema=batch.schema)


LOW = (1 << BLOCK_BITS) - 1


def _accept_unsorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows of an input task whose number was seen under a smaller row id, as far as the ranges held tell.

    A batch that begins before the end of an earlier one is passed on unmarked, so the marks are right in
    any order; only their number depends on it.
    """
    seen, codes, last = SeenRanges(), {}, -(2**63)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row = batch.column("row").to_numpy()
        dup = np.zeros(len(row), bool)
        if row.min() > last:
            last = int(row.max())
            if len(seen.lo) > HELD_RANGES or len(codes) > HELD_RANGES:
                seen, codes = SeenRanges(), {}
            kinds, local = _kinds(batch)
            code = np.array([codes.setdefault(kind, len(codes)) for kind in kinds], np.int64)[local]
            number = (code << (BLOCK_BITS + 1)) + (batch.column("number").to_numpy() & LOW)
            dup = ~_first_of(seen, number, row)
        yield _marked(batch, dup)


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows whose number was seen under a smaller row id. Rows come by (dup, node, series, block, row)."""
    seen, before = SeenRanges(), None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        dup = batch.column("dup").to_numpy(zero_copy_only=False).copy()
        todo = int(np.searchsorted(dup, True))
        if todo:
            part = batch.slice(0, todo)
            run = _runs(part)
            ends = _blocks(part, [0, todo - 1])
            if ends[0] != before:
                seen = SeenRanges()
            number = (run << (BLOCK_BITS + 1)) + (part.column("number").to_numpy() & LOW)
            dup[:todo] = ~_first_of(seen, number, part.column("row").to_numpy())
            # only the block that may go on in the next batch is held
            base, before = run[-1] << (BLOCK_BITS + 1), ends[1]
            at = int(np.searchsorted(seen.lo, base))
            seen.lo, seen.hi = seen.lo[at:] - base, seen.hi[at:] - base
        yield _marked(batch, dup)


def _told(df: DataFrame, row_id: str, producer: str, event_id: str, sequence: str) -> DataFrame:
    """One row each with how its message is told: row, node, seq, kind, series (of an odd identifier: itself), number."""
    rows = df.select(
        F.col(row_id).alias("row"),
        F.col(producer).cast("string").alias("node"),
        F.nullif(F.lower(F.trim(F.col(event_id).cast("string"), F.lit(" \t"))), F.lit("")).alias("eid"),
        F.col(sequence).cast("bigint").alias("seq"),
    )
    # one match of the pattern a row; what follows works on its result, which an identifier that doesn't match equals
    matched = rows.select("*", F.regexp_replace("eid", SEQUENCE, "$1\x01$3\x01$2").alias("m"))
    kind = (
        F.when(F.col("node").isNull() | (F.col("eid").isNull() & F.col("seq").isNull()), ALONE)
        .when(F.col("eid").isNull(), WITHOUT)
        .when(F.col("m") == F.col("eid"), ODD)
        .otherwise(RANGED)
    )
    digits = F.substring_index("m", "\x01", -1)
    named = matched.select("row", "node", "seq", "eid", "m", kind.cast("tinyint").alias("kind"), digits.alias("digits"))
    series = F.when(F.col("kind") == ODD, F.col("eid")).when(
        F.col("kind") == RANGED, F.concat(F.substring_index("m", "\x01", 2), F.lit("\x01"), F.length("digits").cast("string"))
    )
    return named.select("row", "node", "seq", "kind", series.alias("series"), F.when(F.col("kind") == RANGED, F.col("digits")).cast("bigint").alias("number"))


def message_rows(df: DataFrame, row_id: str, producer: str, event_id: str, sequence: str) -> DataFrame:
    """Every row with ``dup``: whether its message also has a row with a smaller row id.

    Rows of one producer are copies if their event_id agrees, letter case and surrounding blanks and tabs
    aside. A row without event_id (null or blank) belongs to the message of the same producer and sequence
    (that of the earliest row, should several messages share the sequence); lacking both, or lacking a producer, it
    stands alone. Row ids are unique and not null. Columns: row_id and ``dup``; other columns are
    ignored. Empty input gives no rows.
    """
    lacking = Observation()
    told = _told(df, row_id, producer, event_id, sequence).observe(lacking, F.count_if(F.col("kind") == WITHOUT).alias("n"))
    told = materialize(told, "messages")
    # the first row of each producer and sequence without identifier stands for all of them
    without = told.where(F.col("kind") == WITHOUT)
    heads = without.groupBy("node", "seq").agg(F.min("row").alias("row"))
    named = told.where(F.col("kind").isin(RANGED, ODD) & F.col("seq").isNotNull())
    if observed(lacking, "n") <= MAX_BROADCAST_KEYS:
        named = named.join(F.broadcast(heads.select("node", "seq")), ["node", "seq"], "left_semi")
    message = F.struct("kind", "series", "number")
    answers = named.groupBy("node", "seq").agg(F.min_by(message, "row").alias("found"))
    resolved = materialize(heads.join(answers, ["node", "seq"], "left").select("row", "node", "found.*"), "resolved")

    line = ["row", "node", "series", "number"]
    ranged = told.where(F.col("kind") == RANGED).select(*line).unionByName(resolved.where(F.col("kind") == RANGED).select(*line))
    ranged = ranged.select("*", F.shiftright("number", BLOCK_BITS).alias("block"), F.lit(False).alias("dup"))
    once = ranged.mapInArrow(_accept_unsorted, ranged.schema)  # in the input tasks: most copies end here
    spread = F.when(F.col("dup"), F.xxhash64("row")).otherwise(F.xxhash64("node", "series", "block"))
    settled = once.repartition(spread).sortWithinPartitions("dup", "node", "series", "block", "row").mapInArrow(_accept, ranged.schema)

    odd = told.where(F.col("kind") == ODD).select("row", "node", "series")
    least = odd.unionByName(resolved.where(F.col("kind") == ODD).select("row", "node", "series")).groupBy("node", "series").agg(F.min("row").alias("row"))
    stays, elsewhere = F.lit(0).alias("known"), F.lit(1).alias("known")
    known = (
        least.select("row", stays)
        .unionByName(resolved.where(F.col("kind").isNull()).select("row", stays))
        .unionByName(resolved.where(F.col("kind") == RANGED).select("row", elsewhere))
    )
    looked_up = told.where(F.col("kind").isin(ODD, WITHOUT)).select("row").join(known, "row", "left")
    looked_up = looked_up.where(F.coalesce("known", F.lit(0)) == 0).select("row", F.col("known").isNull().alias("dup"))
    alone = told.where(F.col("kind") == ALONE).select("row", F.lit(False).alias("dup"))
    return settled.select("row", "dup").unionByName(looked_up).unionByName(alone).select(F.col("row").alias(row_id), "dup")


def deduplicate(df: DataFrame, row_id: str, producer: str, event_id: str, sequence: str) -> DataFrame:
    """The rows of df, exactly one of each message: the one with the smallest row id (see message_rows)."""
    kept = message_rows(df, row_id, producer, event_id, sequence).where(~F.col("dup")).select(row_id)
    return df.join(kept, row_id, "left_semi")
