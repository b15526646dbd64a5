"""Fixtures derived from the given tables, the registered queries over them, and their SQL."""
