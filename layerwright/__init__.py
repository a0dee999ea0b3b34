"""Layered (landing, bronze, silver, gold) data processing as Spark DataFrame operations."""
