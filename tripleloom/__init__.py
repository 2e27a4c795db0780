"""tripleloom: a Spark-native engine for knowledge graphs built from documents and tables."""

__version__ = "0.1.0"
