"""Operators that clean, score, deduplicate, mix and pack training text."""
