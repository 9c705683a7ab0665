"""A PySpark-native analytics engine for append-only logs of namespaced records."""

__version__ = "0.1.0"
