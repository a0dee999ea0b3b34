"""Queries over the benchmark tables, and the SQL each is checked against."""
