"""Operators for large training-text tables: packing, sharding, deduplication, archives, quality."""
