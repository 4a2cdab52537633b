"""tickloom: time-series and tick analytics expressed as PySpark plans."""

__version__ = "0.1.0"
