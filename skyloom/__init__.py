"""Skyloom: a PySpark-native engine for plate solving and star-catalogue analytics."""

__version__ = "0.1.0"
