"""Bindings of the given tables and the checked queries."""
