"""Structured Streaming producers of daily cells."""
