"""Spark jobs that turn document collections into searchable, measurable retrieval tables."""
