"""Queries over the benchmark tables, each with the same result in plain SQL."""
