"""Column functions: boxes, text, hashes."""
