"""Registered queries and the derived tables they read."""
