"""Corpus operators for training data: extraction, filtering, dedup, packing."""
