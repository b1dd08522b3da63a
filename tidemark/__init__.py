"""Temporal utility mining over retail transactions, and hiding of sensitive itemsets, on Spark DataFrames."""
