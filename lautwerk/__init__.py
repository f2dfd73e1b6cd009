"""lautwerk: a Spark-native engine for correspondences between parallel symbol sequences."""

__version__ = "0.1.0"
