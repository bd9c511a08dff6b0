"""Whole runs, from landed pages to records."""
