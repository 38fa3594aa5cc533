"""Annotated-corpus analytics as Spark DataFrame jobs."""
