"""Structured Streaming forms of the job operators and event windows."""
