"""Operators of a training-data pipeline: near duplicates, sharding, tokens, secrets, media, mixing, quality.

Each operator is a function from DataFrames to DataFrames in a module of its own; `queries` registers one query for
each of them. Nothing else in the library imports this subpackage.
"""
