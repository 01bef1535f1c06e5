"""Operators for building training data: filtering, deduplication, search, mixing and packing."""
