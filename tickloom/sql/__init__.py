"""Front end of the tick dialect: statements in, DataFrames out."""

from tickloom.sql.engine import Engine

__all__ = ["Engine"]
