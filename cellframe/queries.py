"""Registered queries over the driver's tables."""

from .plans.registered import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
