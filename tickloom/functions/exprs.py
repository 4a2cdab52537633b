"""Scalar functions of the tick dialect as column expressions (evaluated in generated code)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of a unit.
UNIT_NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "hour": 3600 * 10**9, "day": 86_400 * 10**9, "week": 7 * 86_400 * 10**9}
# Other spellings of units.
UNIT_NAMES = {
    "nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "sec": "s", "minute": "min", "m": "min", "h": "hour", "hr": "hour", "d": "day", "w": "week",
}
EARTH_RADIUS_M = 6_371_008.8


def unit_ns(unit: str) -> int:
    """Nanoseconds of a unit in any spelling, singular or plural."""
    u = unit.strip().lower()
    for name in (u, u[:-1] if u.endswith("s") else u):
        if (found := UNIT_NAMES.get(name, name)) in UNIT_NS:
            return UNIT_NS[found]
    raise ValueError(f"unknown time unit {unit!r}")


def interval_ns(text: str) -> int:
    """Nanoseconds of an interval such as '5 minutes' or '10s'."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * unit_ns(m[2])


def _q(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division that truncates towards zero; 0 where the divisor is 0."""
    a, b = _q(a), _q(b)
    whole = F.call_function("div", a, F.when(b != 0, b))
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(whole)


def floor_div(a: Column | str, n: int) -> Column:
    """Integer quotient rounded down, exact for every bigint (a quotient of doubles isn't)."""
    a = _q(a).cast("bigint")
    return F.call_function("div", a - F.pmod(a, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Division in doubles; 0 where the divisor is 0."""
    a, b = _q(a), _q(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b).cast("double"))


def xbar(x: Column | str, width: int) -> Column:
    """Start of the bucket of a given width that x lies in (truncating, so symmetric around zero)."""
    if width <= 0:
        raise ValueError("bucket width must be positive")
    return F.call_function("div", _q(x), F.lit(width).cast("bigint")) * F.lit(width)


def date_trunc_ns(unit: str, ns: Column | str) -> Column:
    """Start of the unit, aligned to the epoch (so weeks start on Thursdays); nanoseconds."""
    return xbar(ns, unit_ns(unit))


def epoch_s(ns: Column | str) -> Column:
    return F.call_function("div", _q(ns), F.lit(10**9).cast("bigint"))


def epoch_ms(ns: Column | str) -> Column:
    return F.call_function("div", _q(ns), F.lit(10**6).cast("bigint"))


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * F.lit(1000)


def substr_num(x: Column | str, start: int, length: int | None = None) -> Column:
    """Digits start.. (from 1) of the decimal text of x as a number; 0 where that is none."""
    text = _q(x).cast("string")
    part = F.substr(text, F.lit(start), F.lit(length)) if length is not None else F.substr(text, F.lit(start))
    return F.coalesce(part.try_cast("bigint"), F.lit(0).cast("bigint"))


def like_num(x: Column | str, pattern: str) -> Column:
    """LIKE on the decimal text of a number, or on a string."""
    return _q(x).cast("string").like(pattern)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def st_within(lat: Column, lon: Column, lat0: Column, lon0: Column, radius_m: float) -> Column:
    """Whether a point lies within a radius; never for a negative or non-finite radius."""
    if not 0 <= radius_m < float("inf"):
        return F.lit(False)
    return haversine_m(lat, lon, lat0, lon0) <= F.lit(float(radius_m))


def sampled(fraction: float, *key: Column | str) -> Column:
    """Whether a row is in a sample of a fraction of keys: depends on the key alone, not on the data's layout.

    The key's integer columns are mixed by multiplication and shifts modulo 2**31, as any SQL engine can repeat.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    h = F.lit(1).cast("bigint")
    for k in key:
        h = F.pmod(h * F.lit(1_103_515_245) + F.pmod(_q(k).cast("bigint"), F.lit(2_147_483_647)) * F.lit(48_271) + F.lit(12_345), F.lit(2_147_483_647))
    h = F.pmod(h * F.lit(69_621), F.lit(2_147_483_647))
    return h < F.lit(int(fraction * 2_147_483_647))
