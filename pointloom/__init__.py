"""A Spark-native engine for per-point 3D annotation datasets."""
