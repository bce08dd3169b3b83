"""Retrieval-data analytics on Spark."""
