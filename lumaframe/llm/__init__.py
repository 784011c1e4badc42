"""Training-data operators: deduplication, filtering, counting, search, formatting, mixing, packing, extraction.

Nothing outside this subpackage imports it.
"""
