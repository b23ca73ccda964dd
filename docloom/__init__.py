"""Spark jobs for document-centric pipelines."""
