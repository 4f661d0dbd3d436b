"""Spark-native document search, outline extraction and change indexing."""
