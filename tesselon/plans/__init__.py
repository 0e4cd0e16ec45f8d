"""Registered queries with their DuckDB counterparts, and plans made of several operators."""
