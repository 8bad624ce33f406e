"""Passage search, rank fusion and retrieval metrics as DataFrame operators."""
