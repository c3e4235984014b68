"""Named queries over the standard tables, with SQL that a second engine can run."""

from . import agents, documents, files, retrievals, rules, signals  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
