"""Symloom: a PySpark-native engine for code-graph tables."""

__version__ = "0.1.0"
