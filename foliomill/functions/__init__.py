"""Column to Column functions on text, hashes, numbers and JSON."""
