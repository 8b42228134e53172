"""The registered queries: each operator on whole tables, next to the same question in ANSI SQL."""

from . import bronze, facts, kpis, quality, scd, silver, streams, upserts  # noqa: F401  (registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
