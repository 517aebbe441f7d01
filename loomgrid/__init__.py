"""loomgrid: corpus and code-graph analytics as Spark DataFrames."""
