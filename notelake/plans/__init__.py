"""Derived tables, the query suite and its checking SQL."""
