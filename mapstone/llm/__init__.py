"""Training-data operators: deduplication, extraction, scoring, mixing, packing and record output.

Nothing outside this subpackage imports it.
"""
