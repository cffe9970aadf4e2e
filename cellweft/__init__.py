"""Spark-native single-cell, spatial and corpus analytics."""

__version__ = "0.1.0"
