"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames, accepts any extra columns, and states in its docstring what it
returns for nulls, empty texts, repeated rows and empty tables.
"""
