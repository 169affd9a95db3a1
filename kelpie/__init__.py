"""Kelpie: activity, search, vector and graph analytics as plain PySpark DataFrame functions."""

__version__ = "0.1.0"
