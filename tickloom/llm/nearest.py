"""Pairs each record with the nearest one in time of the same entity, by x-fast tries over timestamp bits.

The upper bits of a timestamp, hashed with the entity, are the distributed level of the trie: they choose the
task and the subtree in which a record lies; neighbours beyond a subtree's edges are carried into it by a scan where the tolerance asks for it. Below, a subtree's levels are hash tables of bit prefixes, one per prefix
length, each prefix holding the least and the greatest leaf under it. A query binary-searches the length of the longest
prefix it shares with any leaf; the branch it takes next is empty, so the leaf on the other branch's near side is its
predecessor or successor, and leaves are linked to their neighbours. All queries of a batch of subtrees go through the
levels together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.time import micros

#: Rows gathered before a batch of whole subtrees is searched.
BATCH_ROWS = 200_000
#: Bits of a subtree at most, so that a busy entity is spread over many of them whatever the tolerance: four seconds.
MAX_BITS = 22
#: Subtrees of a stretch, within which and across which neighbours are carried: 2 to this power.
STRETCH_BITS = 10
#: What a row is: the last leaf before its subtree, the first one behind it, a leaf of it, a query.
PRIOR, NEXT, LEAF, QUERY = -2, -1, 0, 1


class XFastTries:
    """Many tries at once: leaves are subtree * 2**bits + low bits, sorted and distinct."""

    def __init__(self, leaves: np.ndarray, bits: int) -> None:
        self.leaves, self.bits = leaves, bits
        self.levels: dict[int, tuple[pd.Index, np.ndarray, np.ndarray]] = {}

    def level(self, length: int) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        """The hash table of prefixes of a length, and positions of each prefix' least and greatest leaf."""
        if length not in self.levels:
            prefixes = self.leaves >> (self.bits - length)
            first = np.flatnonzero(np.concatenate([[True], prefixes[1:] != prefixes[:-1]])) if len(prefixes) else np.empty(0, np.int64)
            last = np.append(first[1:], len(prefixes)) - 1 if len(first) else first
            self.levels[length] = pd.Index(prefixes[first]), first, last
        return self.levels[length]

    def neighbours(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each query's last leaf <= it and first leaf >= it within its subtree; -1 for none."""
        n = len(queries)
        shared, node = np.full(n, -1), np.full(n, -1)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.bits, np.int64)
        open_ = np.flatnonzero(lo <= hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            for length in np.unique(mid).tolist():
                q = open_[mid == length]
                at = self.level(length)[0].get_indexer(queries[q] >> (self.bits - length))
                hit = at >= 0
                shared[q[hit]], node[q[hit]] = length, at[hit]
                lo[q[hit]], hi[q[~hit]] = length + 1, length - 1
            open_ = open_[lo[open_] <= hi[open_]]
        before, after = np.full(n, -1), np.full(n, -1)
        for length in np.unique(shared).tolist():
            if length < 0:
                continue
            q = np.flatnonzero(shared == length)
            _, first, last = self.level(length)
            if length == self.bits:
                before[q] = after[q] = first[node[q]]
                continue
            # all leaves below the shared prefix are on the branch the query doesn't take
            up = (queries[q] >> (self.bits - length - 1)) & 1 == 1
            a, b = q[up], q[~up]
            before[a] = last[node[a]]
            after[b] = first[node[b]]
            tree = self.leaves >> self.bits
            step = before[a] + 1
            same = step < len(tree)
            same[same] = tree[step[same]] == tree[before[a][same]]
            after[a] = np.where(same, step, -1)
            step = after[b] - 1
            same = step >= 0
            same[same] = tree[step[same]] == tree[after[b][same]]
            before[b] = np.where(same, step, -1)
        return before, after


def _subtrees(batches: Iterator[pa.RecordBatch], bits: int, tolerance: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Searches batches of subtrees. Rows come by subtree, its leaves before its queries."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        e, b, side = (table.column(c).to_numpy() for c in ("entity", "block", "side"))
        ends = np.flatnonzero((e[1:] != e[:-1]) | (b[1:] != b[:-1]))
        last = int(ends[-1]) + 1 if len(ends) else 0
        # the last subtree's leaves are whole once a query of it was read; they stay for its further queries
        whole = len(table) if side[-1] == QUERY else last
        if whole:
            yield from _search(table.slice(0, whole), bits, tolerance, schema)
        rest = table.slice(last)
        rest = rest.filter(pa.array(side[last:] != QUERY)) if side[-1] == QUERY else rest
        held, rows = rest.combine_chunks().to_batches(), 0
    if held:
        yield from _search(pa.Table.from_batches(held).combine_chunks(), bits, tolerance, schema)


def _search(table: pa.Table, bits: int, tolerance: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    e, block = table.column("entity").to_numpy(), table.column("block").to_numpy()
    us, side = table.column("us").to_numpy(), table.column("side").to_numpy()
    ids = table.column("id").fill_null(0).to_numpy()
    tree = np.cumsum(np.concatenate([[False], (e[1:] != e[:-1]) | (block[1:] != block[:-1])]))
    # a query may lie up to the tolerance outside its block: it is searched from the block's edge
    low = np.clip(us - (block << bits), 0, (1 << bits) - 1)
    at = (tree << bits) + low
    leaf, ask = np.flatnonzero(side == LEAF), np.flatnonzero(side == QUERY)
    if not len(ask):
        return
    tries = XFastTries(at[leaf], bits)
    # rows of the neighbours: from the query's subtree, else those carried into it
    found = []
    for kind, near in zip((PRIOR, NEXT), tries.neighbours(at[ask]), strict=True):
        carried = np.full(tree[-1] + 1, -1)
        carried[tree[side == kind]] = np.flatnonzero(side == kind)
        found.append(np.where(near >= 0, leaf[near] if len(leaf) else -1, carried[tree[ask]]))
    inf = np.int64(1) << 62
    d0, d1 = (np.where(f >= 0, np.abs(us[f] - us[ask]), inf) for f in found)
    pick, gap = np.where(d0 <= d1, *found), np.minimum(d0, d1)
    ok = np.flatnonzero(gap <= tolerance)
    if len(ok):
        mine = pick[ok]
        q = ask[ok]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e[q], us[q], ids[mine], us[mine], gap[ok])], schema=schema)


def _carried(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """For each subtree with queries the last leaf before it and the first one behind it, by a scan over first and last leaves.

    The scan runs within stretches of subtrees, then over the stretches' own first and last leaves, so that
    an entity's subtrees never meet in one task.
    """
    leaf = F.struct("us", "id")
    ends = leaves.groupBy("entity", "block").agg(F.min(leaf).alias("lo"), F.max(leaf).alias("hi"), F.lit(0).alias("q"))
    need = asked.groupBy("entity", "block").agg(F.lit(1).alias("q"))
    marks = ends.unionByName(need, allowMissingColumns=True).groupBy("entity", "block").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("q").alias("q"))
    marks = marks.withColumn("stretch", F.shiftright("block", STRETCH_BITS))

    def scanned(rows: DataFrame, by: list[str], along: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(along)
        before, behind = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", F.max("hi").over(before).alias("prior"), F.min("lo").over(behind).alias("next"))

    inner = scanned(marks, ["entity", "stretch"], "block")
    outer = scanned(marks.groupBy("entity", "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), ["entity"], "stretch")
    outer = outer.select("entity", "stretch", F.col("prior").alias("prior_"), F.col("next").alias("next_"))
    met = inner.where("q = 1").join(outer, ["entity", "stretch"])
    sides = F.array(
        F.struct(F.lit(PRIOR).alias("side"), F.coalesce("prior", "prior_").alias("leaf")), F.struct(F.lit(NEXT).alias("side"), F.coalesce("next", "next_").alias("leaf"))
    )
    told = met.select("entity", "block", F.explode(sides).alias("s")).where("s.leaf IS NOT NULL")
    return told.select("entity", "block", "s.side", F.col("s.leaf.us").alias("us"), F.col("s.leaf.id").alias("id"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    ts: str,
    left_id: str,
    right_id: str,
    *,
    tolerance_us: int,
    partitions: int | None = None,
) -> DataFrame:
    """Each left record with the right record of its entity nearest in time, at most tolerance_us away.

    Of two equally near the earlier is taken, of several at one instant the one with the smallest id. Rows with a null
    entity, time or id don't take part; left records without a partner have no row; repeated left rows
    (same id, entity and time) give one row. Entity and ids are integers. Columns: left_id, right_id (with
    ``_right`` if both have one name) and ``gap_us`` (right time minus left time). Empty tables give no rows; other columns are ignored.

    Right rows are first reduced to one per instant (combined before the shuffle) and left rows to their distinct instants,
    so a subtree of 2**bits microseconds has at most that many leaves, however many rows it stands for. A query whose tolerance
    reaches over its subtree's edge is searched in the neighbouring one too; where it reaches further (tolerances of more than
    two seconds), every subtree is given the last leaf before it and the first one behind it.
    """
    if tolerance_us < 0:
        raise ValueError("tolerance_us must not be negative")
    bits = min(MAX_BITS, max(1, (2 * tolerance_us).bit_length()))
    far = 2 * tolerance_us >> bits > 0

    def usable(df: DataFrame, row_id: str) -> DataFrame:
        ok = F.col(entity).isNotNull() & F.col(ts).isNotNull() & F.col(row_id).isNotNull()
        return df.where(ok).select(F.col(entity).cast("bigint").alias("entity"), micros(F.col(ts)).alias("us"), F.col(row_id).cast("bigint").alias("id"))

    leaves = usable(right, right_id).groupBy("entity", "us").agg(F.min("id").alias("id"))
    leaves = leaves.select("entity", F.shiftright("us", bits).alias("block"), F.lit(LEAF).alias("side"), "us", "id")
    mine = usable(left, left_id).distinct()
    lo, hi = F.shiftright(F.col("us") - tolerance_us, bits), F.shiftright(F.col("us") + tolerance_us, bits)
    own = F.shiftright("us", bits)
    blocks = own if far else F.explode(F.array_distinct(F.array(lo, own, hi)))
    asked = mine.select("entity", "us").distinct().select("entity", blocks.alias("block"), F.lit(QUERY).alias("side"), "us", F.lit(None).cast("bigint").alias("id"))
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.unionByName(asked)
    if far:
        rows = rows.unionByName(_carried(leaves, asked))
    rows = rows.repartition(n, "entity", "block").sortWithinPartitions("entity", "block", "side", "us")
    names = ["entity", "us", "right_id", "right_us", "gap"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    near = rows.mapInArrow(lambda it: _subtrees(it, bits, tolerance_us, schema), ", ".join(f"{c} bigint" for c in names))
    best = near.groupBy("entity", "us").agg(F.min(F.struct("gap", "right_us", "right_id")).alias("m"))
    other = right_id if right_id != left_id else f"{right_id}_right"
    return mine.join(best, ["entity", "us"]).select(
        F.col("id").alias(left_id), F.col("m.right_id").alias(other), (F.col("m.right_us") - F.col("us")).alias("gap_us")
    )
