"""Spark-native analytics over proposal documents, evidence and their references."""
