"""Registered queries and composed plans."""
