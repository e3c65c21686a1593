"""Chronolith: a Spark-first analytics engine for version-control history."""
