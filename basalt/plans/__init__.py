"""Queries: operators applied to the test tables, each with its SQL."""
