"""Counting-query analytics and private release on Spark."""
