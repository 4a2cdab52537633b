"""Streams: windowed aggregates with watermarks, stateful averages and idempotent sinks."""
