"""Operators for preparing training data: deduplication, extraction, packing, scoring, search."""
