"""PySpark-native analytics over instrument-panel readings: parsing, fusion, evaluation and series repair."""

__version__ = "0.1.0"
