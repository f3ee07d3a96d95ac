"""Queries over the driver's tables, by name, and the flagship plan."""

from skyfix.plans import geometry, scoring, searching, tracks  # noqa: F401  (register)
from skyfix.plans.registry import ORACLES, QUERIES  # noqa: F401
