"""Operators of a training-data pipeline: tokens, near copies, filters, packing, scoring and search."""
