"""Operators: each takes DataFrames and gives DataFrames, or fits a pyspark.ml stage."""
