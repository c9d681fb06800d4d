"""kinweave: similarity graphs, community detection and corpus preparation on PySpark DataFrames."""
