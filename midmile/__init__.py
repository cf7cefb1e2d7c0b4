"""Freight-route risk analytics as Spark jobs."""
