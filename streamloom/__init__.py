"""Behavioural-event analytics as plain Spark DataFrame, SQL and Structured Streaming operations."""
