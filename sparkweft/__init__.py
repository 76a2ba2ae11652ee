"""sparkweft: a PySpark-native engine for turning document corpora into queryable knowledge graphs."""

__version__ = "0.1.0"
