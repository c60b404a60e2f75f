"""Relation analytics on knowledge graphs as Spark jobs."""
