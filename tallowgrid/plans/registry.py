"""Every registered query with its SQL oracle, by name."""

from __future__ import annotations

from tallowgrid.plans.queries import ORACLES, QUERIES

FLAGSHIP = "coverage_quartile_mcc"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
