"""Operators of a training-data pipeline over the corpus tables.

Nothing outside this folder imports it. Every operator takes DataFrames, selects
the columns it needs by name (other columns never reach it, whatever they are
called) and returns a DataFrame; ``queries`` holds the registered queries.
"""
