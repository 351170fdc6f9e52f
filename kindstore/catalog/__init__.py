"""Registered queries over the driver tables, each next to its SQL twin."""

from kindstore.catalog import corpus, evaluation, files, mixing, results, texts, vectors, windows  # noqa: F401
from kindstore.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
