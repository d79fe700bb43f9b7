"""Registered queries: callables of (spark, folder) and the same results in SQL."""
