"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from . import encoding, fitting, marginal, places  # noqa: F401
from .register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
