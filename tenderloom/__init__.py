"""Procurement analytics as Spark DataFrame jobs."""
