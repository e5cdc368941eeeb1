"""Incremental view over a run table that a batch is still writing."""
