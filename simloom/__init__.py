"""Similarity, duplicate and threshold analytics expressed on the Spark DataFrame API."""
