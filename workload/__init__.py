"""Registered queries: input tables derived from the given data, queries and oracle SQL."""
