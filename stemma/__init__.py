"""Analytics over question-bank style document collections, on Spark DataFrames."""
