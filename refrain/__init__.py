"""Spark-first engine for finding, explaining and removing repeated spans in timed sequences."""
