"""Segment-level analytics over long documents, written as Spark DataFrame operators."""
