"""Operators for building language-model training corpora on Spark.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame with its own general interface; ``queries`` holds
the thin registered queries and ``oracles`` their SQL counterparts.
"""
