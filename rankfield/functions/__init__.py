"""Ranked-page analytics on Spark."""
