"""Graph-first code analytics on PySpark DataFrames."""
