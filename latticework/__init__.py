"""Spark-native topology analytics over frames of molecules, and corpus preparation beside it."""

__version__ = "0.1.0"
