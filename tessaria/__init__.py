"""Spark-native analytics operators for listing data; every operator maps DataFrames to DataFrames."""
