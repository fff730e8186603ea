"""kinloom: sequence-overlap graphs, copy-number analysis and corpus preparation on Spark DataFrames."""

__version__ = "0.2.0"
