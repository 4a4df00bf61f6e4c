"""Upkeep of answers over streams."""
