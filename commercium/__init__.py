"""Commercial analytics on Spark: pricing, product lifecycle and competitive jobs.

Every job is a function from DataFrames to a DataFrame.  Jobs are lazy unless
their docstring says that they stage an intermediate table.
"""
