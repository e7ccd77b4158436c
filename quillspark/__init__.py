"""quillspark: a PySpark-native text-corpus analytics engine."""

__version__ = "0.1.0"
