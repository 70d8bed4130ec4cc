"""Spark-native engine for hierarchical, periodically re-issued assessment data."""

__version__ = "0.1.0"
