"""Operators for large text corpora: scoring, sharding, packing, deduplication, search, tokenizing.

Nothing outside this package imports it.
"""
