"""Span and event analytics as Spark DataFrame plans."""
