"""Aggregates by event time that are corrected while late records arrive, by checkpoint and replay.

Events are keyed by a shard of event time; a shard with many events is salted by a hash of the event's id,
into as many parts as its size asks for, and the parts' changes are added up. Each part replays its arrivals in
order. Its state is the list of accepted events in event-time order with a checkpoint of the aggregate every so many
events. An event in order extends the list; late ones restore the last checkpoint before the earliest of
them, the sorted suffix behind it is replayed with them in place, and the outputs it changes are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import floor_div

ON_TIME, CORRECTED, TOO_LATE = "on_time", "corrected", "too_late"


class Replay:
    """Ordered state of one part: event times, and checkpoints (position, counts of the periods up to there)."""

    def __init__(self, period_ns: int, every: int) -> None:
        self.period_ns, self.every = period_ns, every
        self.times = np.empty(0, np.int64)
        self.marks: list[tuple[int, int, int]] = [(0, -(2**63), 0)]  # position, last period so far, its count so far
        self.outputs: dict[int, int] = {}
        self.replayed = 0

    def arrive(self, times: np.ndarray) -> dict[int, int]:
        """Takes a batch of accepted event times; gives the periods whose count changed, with the change."""
        times = np.sort(times)
        at = int(np.searchsorted(self.times, times[0], side="right"))
        k = bisect_right(self.marks, at, key=lambda m: m[0]) - 1
        position, period, count = self.marks[k]
        del self.marks[k + 1 :]
        suffix = np.concatenate([self.times[position:], times])
        suffix.sort(kind="stable")
        self.times = np.concatenate([self.times[:position], suffix])
        self.replayed += len(suffix)
        return self._replay(position, period, count, suffix)

    def _replay(self, position: int, period: int, count: int, suffix: np.ndarray) -> dict[int, int]:
        periods = suffix // self.period_ns
        starts = np.flatnonzero(np.concatenate([[True], periods[1:] != periods[:-1]]))
        sizes = np.diff(np.append(starts, len(periods)))
        changed = {}
        for p, first, size in zip(periods[starts].tolist(), starts.tolist(), sizes.tolist(), strict=True):
            before = count if p == period else 0
            step = -(position + first) % self.every
            for cut in range(step or self.every, size + 1, self.every):
                self.marks.append((position + first + cut, p, before + cut))
            total = before + size
            if (old := self.outputs.get(p, 0)) != total:
                changed[p] = total - old
                self.outputs[p] = total
        return changed


def _replay_part(pdf: pd.DataFrame, period_ns: int, lateness_ns: int, publish_ns: int, every: int, events: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["arrival", "event", "id"], kind="stable")
    event, arrival = pdf["event"].to_numpy(np.int64), pdf["arrival"].to_numpy(np.int64)
    end = (event // period_ns + 1) * period_ns
    accepted = arrival <= end + lateness_ns
    state = Replay(period_ns, every)
    out: dict[tuple[int, int], int] = {}
    status = np.full(len(event), TOO_LATE, object)
    took = np.flatnonzero(accepted)
    # arrivals are taken in publication slots, cut where a period ends; what arrives before its period's end is published at the end
    slot, turn = arrival[took] // publish_ns, arrival[took] // period_ns
    for rows in np.split(took, np.flatnonzero((np.diff(slot) != 0) | (np.diff(turn) != 0)) + 1) if len(took) else []:
        clock = int(arrival[rows[0]])
        published = {}
        for p, change in state.arrive(event[rows]).items():
            first = (p + 1) * period_ns
            published[p] = at = first if clock < first else (clock // publish_ns + 1) * publish_ns
            out[p, at] = out.get((p, at), 0) + change
        if events:
            # an event corrects if the output that its replay changed replaces one published before
            status[rows] = [CORRECTED if published[p] > (p + 1) * period_ns else ON_TIME for p in (event[rows] // period_ns).tolist()]
    if not events:
        return pd.DataFrame([(p * period_ns, at, n) for (p, at), n in out.items()], columns=["period_ns", "published_ns", "change"]).astype("int64")
    if (sum(out.values()) != len(took)) or ((status[took] == CORRECTED) != (arrival[took] >= end[took])).any():
        raise AssertionError("the replayed outputs don't agree with the arrivals")
    return pd.DataFrame({"id": pdf["id"], "event": event, "arrival": arrival, "period_ns": end - period_ns, "status": status})


def _parts(df: DataFrame, event_ns: str, arrival_ns: str, event_id: str, shard_ns: int, part_rows: int) -> DataFrame:
    rows = df.where(F.col(event_ns).isNotNull() & F.col(arrival_ns).isNotNull()).select(
        F.col(event_id).cast("string").alias("id"), F.col(event_ns).alias("event"), F.col(arrival_ns).alias("arrival")
    ).withColumn("shard", floor_div("event", shard_ns))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("salts"))
    return rows.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))


def first_arrivals(df: DataFrame, event_id: str, event_ns: str, arrival_ns: str) -> DataFrame:
    """Of the rows of one id the one that arrived first (then the one of the earliest event time).

    Rows without both times are dropped; rows with a null id are each their own event. Columns: id, event and
    arrival under their given names.
    """
    usable = df.where(F.col(event_ns).isNotNull() & F.col(arrival_ns).isNotNull()).select(event_id, event_ns, arrival_ns)
    named = usable.where(F.col(event_id).isNotNull()).groupBy(event_id).agg(F.min(F.struct(F.col(arrival_ns).alias("a"), F.col(event_ns).alias("e"))).alias("m"))
    return named.select(event_id, F.col("m.e").alias(event_ns), F.col("m.a").alias(arrival_ns)).unionByName(usable.where(F.col(event_id).isNull()))


def event_status(
    df: DataFrame,
    event_id: str,
    event_ns: str,
    arrival_ns: str,
    *,
    period_s: int = 300,
    lateness_s: int = 900,
    shard_s: int = 86_400,
    part_rows: int = 50_000,
    every: int = 256,
) -> DataFrame:
    """Every event with its period and whether it was counted on time, as a correction, or came too late.

    An event that arrives before its period's end is ``on_time``; until ``lateness_s`` after it (limit included)
    ``corrected``; later ``too_late``. Columns: ``id``, ``event``, ``arrival``, ``period_ns``, ``status``.
    Rows without both times don't take part; empty input gives no rows.
    """
    parts = _parts(df, event_ns, arrival_ns, event_id, shard_s * 10**9, part_rows)
    args = (period_s * 10**9, lateness_s * 10**9, 60 * 10**9, every, True)
    return parts.groupBy("shard", "salt").applyInPandas(
        lambda pdf: _replay_part(pdf, *args), "id string, event bigint, arrival bigint, period_ns bigint, status string"
    )


def corrected_counts(
    df: DataFrame,
    event_id: str,
    event_ns: str,
    arrival_ns: str,
    *,
    period_s: int = 300,
    lateness_s: int = 900,
    publish_s: int = 60,
    shard_s: int = 86_400,
    part_rows: int = 50_000,
    every: int = 256,
) -> DataFrame:
    """The published counts of every period: the first one at its end, then one for each correction.

    Late events are taken in publication slots of ``publish_s`` and published at the slot's end. Columns:
    ``period_start_s``, ``published_s``, ``n`` (the count as published) and ``version`` (1, 2, ...). The last
    version stands. A period all of whose events came too late has no row.
    """
    parts = _parts(df, event_ns, arrival_ns, event_id, shard_s * 10**9, part_rows)
    args = (period_s * 10**9, lateness_s * 10**9, publish_s * 10**9, every, False)
    changes = parts.groupBy("shard", "salt").applyInPandas(
        lambda pdf: _replay_part(pdf, *args), "period_ns bigint, published_ns bigint, change bigint"
    )
    along = Window.partitionBy("period_ns").orderBy("published_ns")
    return (
        changes.groupBy("period_ns", "published_ns")
        .agg(F.sum("change").alias("change"))
        .select(
            F.expr("period_ns div 1000000000").alias("period_start_s"),
            F.expr("published_ns div 1000000000").alias("published_s"),
            F.sum("change").over(along).alias("n"),
            F.row_number().over(along).alias("version"),
        )
    )
