"""seamline: a PySpark-native code-retrieval and corpus-processing engine."""

__version__ = "0.1.0"
