"""Quiver: Spark-native vector search and corpus preparation."""
