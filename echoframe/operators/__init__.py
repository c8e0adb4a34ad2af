"""Operators over units(idx, name, body, filename) and embeddings(idx, vector)."""
