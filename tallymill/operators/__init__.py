"""Operators over encoded tables, supports and answers."""
