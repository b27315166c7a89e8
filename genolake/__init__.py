"""Genome-sequence analytics as Spark DataFrame jobs."""
