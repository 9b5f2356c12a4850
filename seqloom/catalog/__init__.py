"""Registered queries over the given tables, with the SQL each one must equal."""
