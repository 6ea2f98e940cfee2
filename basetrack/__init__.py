"""Per-base track analytics on Spark."""

__version__ = "0.2.0"
