"""Snapshot-versioned code analytics on Spark DataFrames."""
