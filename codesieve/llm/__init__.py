"""Operators of a training-data pipeline.

Each operator is a module with a general interface; `queries` holds the thin queries of the contract. Nothing outside
this folder imports it.
"""
