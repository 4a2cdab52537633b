"""Schedules and cancellation."""

import threading
import time

import pytest

from tickloom.schedule import CancellationToken, Cancelled, Scheduler


class Clock:
    now = 1_700_000_000.0 // 86_400 * 86_400

    def __call__(self):
        return self.now


def test_interval_daily_once_and_cancel():
    clock, ran = Clock(), []
    s = Scheduler(clock)
    s.interval("i", 10, lambda: ran.append("i"))
    s.daily_at("d", 0, 1, lambda: ran.append("d"))
    s.once_at("o", clock.now + 15, lambda: ran.append("o"))
    gone = s.interval("gone", 5, lambda: ran.append("gone"))
    assert s.cancel(gone) and not s.cancel(gone) and not s.cancel(99)
    assert s.run_due() == 0
    clock.now += 20
    assert s.run_due() == 2 and ran == ["i", "o"]
    clock.now += 40
    s.run_due()
    assert ran == ["i", "o", "i", "d"]  # turns missed are made up by one run
    clock.now += 86_400
    s.run_due()
    assert ran.count("d") == 2


def test_a_failing_job_keeps_its_schedule():
    clock = Clock()
    s = Scheduler(clock)
    job = s.interval("bad", 1, lambda: 1 / 0)
    for _ in range(3):
        clock.now += 1
        s.run_due()
    assert (s.jobs[job].runs, s.jobs[job].failures) == (3, 3) and "ZeroDivisionError" in s.jobs[job].last_error
    with pytest.raises(ValueError, match="positive"):
        s.interval("x", 0, print)
    with pytest.raises(ValueError, match="time of day"):
        s.daily_at("x", 24, 0, print)


def test_thread():
    done = threading.Event()
    s = Scheduler()
    s.start()
    s.once_at("now", time.time(), done.set)
    assert done.wait(5)
    s.stop()


def test_cancelled_queries(spark):
    token = CancellationToken(spark, timeout_s=1.0)
    began = time.time()

    def sleep(frames):
        for frame in frames:
            time.sleep(25)
            yield frame

    with pytest.raises(Cancelled), token.running():
        spark.range(2).mapInPandas(sleep, "id bigint").count()
    assert time.time() - began < 20
    with pytest.raises(Cancelled), token.running():
        pass
    with CancellationToken(spark).running():
        assert spark.range(10).count() == 10
