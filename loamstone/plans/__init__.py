"""The registered queries over the engine's operators."""

from loamstone.plans import corpus, files, search, serving  # noqa: F401
from loamstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
