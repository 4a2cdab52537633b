"""Splayed tables."""

import datetime as dt

import numpy as np
import pytest

from tickloom.migrate import splayed


def write(path, kind, values, layout):
    path.write_bytes(bytes([1, kind, 0, 0, 0, 0, 0, 0]) + np.array(values, layout).tobytes())


def test_load(spark, tmp_path):
    (tmp_path / "sym").write_bytes(b"AAPL\0MSFT\0")
    for day, n in (("2024.03.04", 3), ("2024.03.05", 2)):
        t = tmp_path / day / "trade"
        t.mkdir(parents=True)
        write(t / "sym", 11, [0, 1, 0][:n], "<i4")
        write(t / "price", 9, [1.5, 2.5, 3.5][:n], "<f8")
        write(t / "size", 7, [10, -(2**63), 30][:n], "<i8")
        write(t / "time", 12, [0, 1, 2][:n], "<i8")
        write(t / "day", 14, [8829] * n, "<i4")
    rows = sorted(tuple(r) for r in splayed.load(spark, str(tmp_path), "trade").select("date_part", "time", "sym", "price", "size", "day").collect())
    assert rows[0] == ("2024.03.04", splayed.EPOCH_NS, "AAPL", 1.5, 10, dt.date(2024, 3, 4))
    assert rows[1][2:5] == ("MSFT", 2.5, None)
    assert len(rows) == 5
    with pytest.raises(ValueError, match="no table"):
        splayed.load(spark, str(tmp_path), "quote")
    with pytest.raises(ValueError, match="unknown column type"):
        splayed.column(bytes([1, 77, 0, 0, 0, 0, 0, 0]), [])
