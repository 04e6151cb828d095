"""Causal estimation and customer-lifecycle analytics on Spark DataFrames."""
