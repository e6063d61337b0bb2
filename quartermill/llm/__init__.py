"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface and the thin query
that applies it to a whole table; :mod:`quartermill.llm.catalog` lists the
queries and the DuckDB statements that state the same result.
"""
