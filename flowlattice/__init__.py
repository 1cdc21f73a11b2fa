"""flowlattice: transaction-graph analytics expressed as plain Spark DataFrames."""

__version__ = "0.1.0"
