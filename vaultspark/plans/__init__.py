"""Composite plans: index, search, the registered queries and the operation registry."""
