"""Sequence-to-graph analytics on PySpark DataFrames."""
