"""Consolidate loosely matching tabular exports with Spark."""
