"""tesserae: a PySpark-native index and search engine for source code and text."""

__version__ = "0.1.0"
