"""Spark-native analytics for e-commerce interactions: layers, recommenders, quality, lineage."""
