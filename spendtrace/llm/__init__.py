"""Operators for preparing training text: archives, sharding, filters, near-dedup, tokens, packing."""
