"""Operators of a training-data pipeline: text, pages and vectors as Spark jobs."""
