"""Spark-first analytics over long-form media timelines."""

__version__ = "0.1.0"
