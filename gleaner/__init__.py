"""Gleaner: find, qualify, deduplicate and persist records as Spark DataFrame plans."""

__version__ = "0.1.0"
