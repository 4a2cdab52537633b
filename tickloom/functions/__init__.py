"""Column functions."""

from tickloom.functions.time import micros, nanos_of, wall_ns

__all__ = ["micros", "nanos_of", "wall_ns"]
