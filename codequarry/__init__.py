"""Codebase and commit-history analytics as Spark DataFrame jobs."""
