"""All queries of the core, with their SQL."""

from __future__ import annotations

from tickloom.plans import agents, dialect, problems, relational, statements, streams, temporal

_PARTS = (problems, relational, temporal, agents, dialect, streams, statements)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = QUERIES["xbar_ohlcv"]
