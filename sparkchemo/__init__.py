"""Chemometric modelling and authentication on Spark DataFrames."""
