"""Registered queries: adapters from the given tables, queries and SQL oracles."""
