"""Lexframe: retrieval over versioned legal text, expressed as Spark DataFrame transformations."""

__version__ = "0.1.0"
