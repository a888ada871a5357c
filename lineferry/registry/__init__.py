"""All registered queries."""

from lineferry.registry import checking, conversions, extracts, filtering, lookups, scans, sinks
from lineferry.registry.base import ORACLES, QUERIES

flagship = sinks.flagship

__all__ = ["ORACLES", "QUERIES", "conversions", "flagship", "scans"]
