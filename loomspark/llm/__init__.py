"""Training-data operators: quality, language, dedup, formatting, mixing and packing.

Nothing outside this subpackage imports it.
"""
