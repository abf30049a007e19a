"""Parallel-corpus preparation on Spark."""
