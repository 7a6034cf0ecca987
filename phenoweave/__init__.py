"""Phenotype-profile similarity ranking on Spark DataFrames."""
