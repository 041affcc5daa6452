"""Checks that stop a job: a violation is an error, never a note."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Violation(ValueError):
    """What a check found; the message shows some of the rows. ``counts``: rows by rule, where a check counts them."""

    def __init__(self, message: str, counts: dict[str, int] | None = None):
        super().__init__(message)
        self.counts = counts or {}


def require_empty(found: DataFrame, what: str, shown: int = 20) -> None:
    """Raise if a violation query has rows."""
    rows = found.limit(shown + 1).collect()
    if rows:
        more = ", and more" if len(rows) > shown else ""
        raise Violation(f"{what}: {', '.join(str(tuple(r)) for r in rows[:shown])}{more}")
