"""Counts per period of event time on a stream, corrected while late records arrive, by checkpoint and replay.

The state of a key is the ordered list of accepted event times of the periods that may still change, with checkpoints of
the running count. Late records restore the checkpoint before the earliest of them and replay the sorted suffix; the outputs
that change are sent again. Periods past the cut-off are closed: their times leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.late import Replay

STATE = "times array<bigint>, marks array<array<bigint>>, periods array<bigint>, counts array<bigint>, clock bigint"


def corrected_counts(rows: DataFrame, key: str, event_ns: str, arrival_ns: str, *, period_s: int = 300, lateness_s: int = 900, every: int = 256) -> DataFrame:
    """A stream of replaced outputs: key, ``period_start_s``, ``n`` and ``arrived_ns`` (the key's clock when it was sent).

    A record counts if it arrives until ``lateness_s`` after its period's end, by its own arrival time. Records of a micro-batch are
    taken in order of arrival. The greatest ``n`` of a period stands. A busy key is spread by giving a finer key (with a
    salt) and adding the counts up.
    """
    period, lateness = period_s * 10**9, lateness_s * 10**9
    kind = dict(rows.dtypes)[key]
    usable = rows.where(F.col(event_ns).isNotNull() & F.col(arrival_ns).isNotNull())

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values([arrival_ns, event_ns], kind="stable")
        replay, clock = Replay(period, every), 0
        if state.exists:
            times, marks, periods, counts, clock = state.get
            replay.times = np.array(times, np.int64)
            replay.marks = [tuple(m) for m in marks]
            replay.outputs = dict(zip(periods, counts, strict=True))
        event, arrival = pdf[event_ns].to_numpy(np.int64), pdf[arrival_ns].to_numpy(np.int64)
        taken = event[arrival <= (event // period + 1) * period + lateness]
        changed = replay.arrive(taken) if len(taken) else {}
        clock = max(clock, int(arrival[-1]))
        out = pd.DataFrame({key: [k[0]] * len(changed), "period_start_s": [p * period_s for p in changed], "n": [replay.outputs[p] for p in changed], "arrived_ns": [clock] * len(changed)})
        _close(replay, (clock - lateness) // period - 1)
        state.update((replay.times.tolist(), [list(m) for m in replay.marks], list(replay.outputs), list(replay.outputs.values()), clock))
        yield out

    schema = f"{key} {kind}, period_start_s bigint, n bigint, arrived_ns bigint"
    return usable.select(key, event_ns, arrival_ns).groupBy(key).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def _close(replay: Replay, last: int) -> None:
    """Forgets the periods up to ``last``, which no record can change any more."""
    cut = int(np.searchsorted(replay.times, (last + 1) * replay.period_ns))
    if not cut:
        return
    replay.times = replay.times[cut:]
    kept = [(at - cut, p, n) for at, p, n in replay.marks if at - cut > 0]
    replay.marks = [(0, -(2**63), 0), *kept]
    replay.outputs = {p: n for p, n in replay.outputs.items() if p > last}
