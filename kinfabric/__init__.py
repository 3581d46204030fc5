"""kinfabric: identity resolution, graph trust and sybil analytics on Spark DataFrames."""

__version__ = "0.1.0"
