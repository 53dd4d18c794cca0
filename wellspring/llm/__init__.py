"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a plain function from DataFrames to
DataFrames; ``queries`` holds the registered queries that apply them to the standard tables.
"""
