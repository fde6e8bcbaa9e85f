"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator module takes and returns
DataFrames; ``queries.py`` applies them to the given tables and ``oracle.py`` holds their SQL.
"""
