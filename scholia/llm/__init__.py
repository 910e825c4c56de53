"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Every operator takes
DataFrames and column names and returns DataFrames; ``queries.py`` holds
the thin registered queries and their SQL.
"""
