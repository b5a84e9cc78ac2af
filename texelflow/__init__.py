"""Supercompressed texture containers as Spark data."""
