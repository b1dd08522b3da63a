"""Operators for preparing training data: token counting, packing, near-duplicate search, filtering, scoring."""
