"""Tick normalization, de-duplication, loading and feed-health jobs on Spark."""
