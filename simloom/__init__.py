"""simloom: a Spark-native engine for string similarity, record linkage and dataset construction."""

__version__ = "0.1.0"
