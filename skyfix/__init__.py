"""Spark-first analytics engine for position tracking from video frames."""

__version__ = "0.1.0"
