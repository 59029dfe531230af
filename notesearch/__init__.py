"""Spark-native retrieval over noisy business documents."""
