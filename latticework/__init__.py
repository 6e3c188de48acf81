"""Latticework: framework graphs and corpus preparation on Spark DataFrames."""
