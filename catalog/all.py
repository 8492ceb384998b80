"""Imports every section so that the registry is filled."""

from catalog import files, measure, prepare, produce  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
