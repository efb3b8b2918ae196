"""Spark-first analytics for versioned text corpora."""
