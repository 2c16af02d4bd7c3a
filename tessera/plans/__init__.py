"""Fixture tables, registered queries and their DuckDB twins."""
