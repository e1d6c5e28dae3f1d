"""Operators for preparing training text: cleaning, deduplication, mixing, packing and sharding."""
