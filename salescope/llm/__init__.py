"""Operators that prepare training data: deduplication, mixing, packing, search, extraction and scoring."""
