"""Spark jobs for document memory, retrieval and code-graph analytics."""
