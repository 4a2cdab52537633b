"""Jobs run at intervals, daily or once, and queries that can be cancelled."""

from __future__ import annotations

import heapq
import itertools
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

DAY_S = 86_400.0


@dataclass(order=True)
class Job:
    """When a job is next due (seconds since the epoch), how often, and what came of it."""

    due: float
    id: int
    name: str = field(compare=False)
    run: Callable[[], Any] = field(compare=False, repr=False)
    every: float | None = field(compare=False, default=None)
    active: bool = field(compare=False, default=True)
    runs: int = field(compare=False, default=0)
    failures: int = field(compare=False, default=0)
    last_error: str | None = field(compare=False, default=None)


class Scheduler:
    """Runs jobs one after another in a thread of the driver; a job that fails is counted and keeps its schedule.

    ``clock`` gives seconds since the epoch; ``run_due`` runs what is due by then without a thread.
    """

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self.clock, self.jobs = clock, {}
        self._queue: list[Job] = []
        self._ids = itertools.count(1)
        self._lock, self._wake, self._thread = threading.Lock(), threading.Condition(), None
        self._stopped = False

    def _add(self, name: str, due: float, every: float | None, run: Callable[[], Any]) -> int:
        job = Job(due, next(self._ids), name, run, every)
        with self._lock:
            self.jobs[job.id] = job
            heapq.heappush(self._queue, job)
        with self._wake:
            self._wake.notify()
        return job.id

    def interval(self, name: str, seconds: float, run: Callable[[], Any]) -> int:
        """Every so many seconds, first after as many."""
        if seconds <= 0:
            raise ValueError("an interval must be positive")
        return self._add(name, self.clock() + seconds, seconds, run)

    def daily_at(self, name: str, hour: int, minute: int, run: Callable[[], Any]) -> int:
        """Every day at a time of day, UTC."""
        if not (0 <= hour < 24 and 0 <= minute < 60):
            raise ValueError("no such time of day")
        now, at = self.clock(), hour * 3600.0 + minute * 60.0
        due = now // DAY_S * DAY_S + at
        return self._add(name, due if due > now else due + DAY_S, DAY_S, run)

    def once_at(self, name: str, when: float, run: Callable[[], Any]) -> int:
        """Once, at an instant in seconds since the epoch; at once if that has passed."""
        return self._add(name, when, None, run)

    def cancel(self, job: int) -> bool:
        """Whether there was such a job still to run."""
        with self._lock:
            found = self.jobs.get(job)
            was = found is not None and found.active
            if was:
                found.active = False
            return was

    def run_due(self) -> int:
        """Runs every job that is due, in order of their times; returns how many ran. Missed turns of a job are made up by one run."""
        ran = 0
        while True:
            with self._lock:
                while self._queue and not self._queue[0].active:
                    heapq.heappop(self._queue)
                if not self._queue or self._queue[0].due > self.clock():
                    return ran
                job = heapq.heappop(self._queue)
            try:
                job.run()
            except Exception as error:
                job.failures += 1
                job.last_error = f"{type(error).__name__}: {error}"
            job.runs += 1
            ran += 1
            with self._lock:
                if job.every is None:
                    job.active = False
                elif job.active:
                    job.due += (max(0.0, self.clock() - job.due) // job.every + 1) * job.every
                    heapq.heappush(self._queue, job)

    def start(self) -> None:
        self._stopped = False
        self._thread = threading.Thread(target=self._loop, daemon=True, name="schedule")
        self._thread.start()

    def stop(self) -> None:
        """Ends after the job at hand."""
        self._stopped = True
        with self._wake:
            self._wake.notify()
        if self._thread:
            self._thread.join()

    def _loop(self) -> None:
        while not self._stopped:
            self.run_due()
            with self._wake:
                due = self._queue[0].due if self._queue else None
                self._wake.wait(timeout=1.0 if due is None else min(1.0, max(0.0, due - self.clock())))


class Cancelled(RuntimeError):
    """The query was cancelled."""


class CancellationToken:
    """Cancels the Spark jobs that are run under it, from any thread, at once or after ``timeout_s`` seconds."""

    _n = itertools.count(1)

    def __init__(self, spark: SparkSession, timeout_s: float | None = None) -> None:
        self.spark, self.cancelled = spark, False
        self.tag = f"tickloom-{id(self)}-{next(self._n)}"
        self._timer = threading.Timer(timeout_s, self.cancel) if timeout_s is not None else None

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def running(self):
        """Actions inside belong to the token; Cancelled is raised if they were cut short, or it was cancelled before."""
        if self.cancelled:
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        if self._timer:
            self._timer.daemon = True
            self._timer.start()
        try:
            yield self
        except Exception as error:
            if self.cancelled:
                raise Cancelled(self.tag) from error
            raise
        finally:
            if self._timer:
                self._timer.cancel()
            self.spark.sparkContext.removeJobTag(self.tag)
