"""Registered queries by area; importing them fills the registry."""

from . import relational, aggregates, graphs, evidence, times, operations, reasoning, upkeep, chunking, classes, resolution, evidence_paths, negative, text, knowledge, loads, seeds  # noqa: F401, I001  the flagship comes first
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
