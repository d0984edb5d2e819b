"""Operators of a large-scale training-data pipeline: counting, deduplication, extraction, scanning and mixing."""
