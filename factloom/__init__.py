"""Spark jobs over fact tables, retrieval results and answer evaluations."""
