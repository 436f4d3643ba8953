"""Deterministic prose analytics on Spark."""
