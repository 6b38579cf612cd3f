"""Metric facts on Spark: cells, comparisons, facts, and checked narratives."""
