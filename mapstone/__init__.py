"""mapstone: an architecture-graph analytics engine expressed as Spark DataFrames."""

__version__ = "0.1.0"
