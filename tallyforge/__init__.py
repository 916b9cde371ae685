"""Procurement and catalogue analytics on Spark DataFrames."""
