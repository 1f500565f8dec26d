"""Spark-first analytics over append-only event journals."""
