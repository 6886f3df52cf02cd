"""factgraph: temporal fact-graph operators on Spark DataFrames."""

__version__ = "0.1.0"
