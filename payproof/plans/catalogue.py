"""Importing this module registers every query."""
from payproof.plans import bank, checks, files, functions, gates, outputs, reviews  # noqa: F401
from payproof.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
