"""Registered queries over the given tables, and independent SQL to check them."""
