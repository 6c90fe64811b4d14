"""Registered queries: operators over projections of the given tables, with the same in SQL."""
