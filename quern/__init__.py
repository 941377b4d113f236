"""quern: a PySpark-native engine for multilingual interview analytics."""

__version__ = "0.1.0"
