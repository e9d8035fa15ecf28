"""Readers and writers: canonical tables, glossaries, packages and HTML."""
