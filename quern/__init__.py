"""quern: a PySpark-native corpus analytics engine."""

__version__ = "0.1.0"
