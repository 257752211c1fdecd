"""Metric questions, vector search and text audit as Spark DataFrame jobs."""
