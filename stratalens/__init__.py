"""Spark-first hybrid retrieval, evidence analytics and corpus preparation."""
