"""Spark-native self-organizing-map and ensemble-clustering engine."""
