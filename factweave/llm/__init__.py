"""Training-data operators on Spark DataFrames.

Nothing else in the library imports this subpackage.  Modules hold the
operators with their general interfaces; ``queries`` holds the thin queries
registered by the repository's entry point.
"""
