"""Statute corpora as Spark tables: compile, check, verify and export."""

__version__ = "0.1.0"
