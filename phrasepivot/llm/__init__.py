"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator has a general
interface in a module of its own; ``queries`` holds the thin registered
queries and their SQL.
"""
