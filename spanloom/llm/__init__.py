"""Operators for large text corpora: deduplication, filtering, tokenizing and packing."""
