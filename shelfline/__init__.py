"""Spark-native analytics over fetched commerce pages and their ingestion history."""
