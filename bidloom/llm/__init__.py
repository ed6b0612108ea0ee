"""Operators for training data: text repair, deduplication, linking, packing, leakage and quality."""
