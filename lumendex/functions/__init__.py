"""Column builders: vectors, hashes, text, paths."""
