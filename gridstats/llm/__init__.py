"""Operators for preparing a text corpus: counting, filtering, deduplication, mixing and packing."""
