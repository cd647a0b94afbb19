"""Per-file extraction: pure functions of a path and its source, run inside partitions."""
