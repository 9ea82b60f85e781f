"""Tessera: a Spark-native library for catalogue-style records and corpus preparation.

Everything is a function from DataFrames (or Columns) to DataFrames (or Columns); nothing runs until the caller acts.
"""
