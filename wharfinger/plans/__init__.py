"""Queries: operators put together over the tables at hand."""
