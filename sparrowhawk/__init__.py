"""Sparrowhawk: code and text security analytics on Spark DataFrames."""
