"""Registered queries over fixture views of the provided tables, each with the SQL that DuckDB runs on the same tables."""
