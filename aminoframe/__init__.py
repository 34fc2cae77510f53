"""Numeric features of protein sequences, computed as Spark column expressions."""

__version__ = "0.1.0"
