"""Queries and stage lists."""
