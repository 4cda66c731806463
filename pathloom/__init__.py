"""pathloom: a PySpark-native analytics engine for whole-slide image data."""

__version__ = "0.1.0"
