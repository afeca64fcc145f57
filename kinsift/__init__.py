"""Duplicate verdicts over whole tables, on Spark."""
