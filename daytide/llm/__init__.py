"""Operators for preparing training data: deduplication, filters, scores, packing, archives."""
