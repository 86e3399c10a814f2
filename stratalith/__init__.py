"""A Spark-native engine that builds, searches, compares and queries document collections."""

__version__ = "0.1.0"
