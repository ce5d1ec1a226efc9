"""Registered queries, their oracle SQL and plan helpers."""
