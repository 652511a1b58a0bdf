"""Operators over the index tables: search, ranking, maintenance, chunking, embedding."""
