"""Projections of input tables, the named queries, and their SQL."""
