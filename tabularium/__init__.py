"""tabularium: a PySpark-native engine for harvesting published reference tables."""

__version__ = "0.1.0"
