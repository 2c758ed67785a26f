"""Passage retrieval, grounded answering and their evaluation as Spark jobs."""

__version__ = "0.1.0"
