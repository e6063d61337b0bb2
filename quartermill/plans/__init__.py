"""Named analytical queries and derived tables, by family.

Each module has ``QUERIES``: name -> (function of Tables, DuckDB statement or None).
"""
