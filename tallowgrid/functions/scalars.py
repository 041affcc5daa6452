"""Column functions with the engine's rules for missing values and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comparable(x: Column) -> Column:
    """A double rounded for comparison between engines; the nudge keeps ties on one side."""
    return F.round(x + F.lit(1e-10), 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def skeleton_block(inchikey: Column) -> Column:
    """The first block of an InChIKey, which names the molecule's skeleton."""
    return F.split_part(inchikey, F.lit("-"), F.lit(1))


def known_or_null(known: Column, x: Column) -> Column:
    """x, 0 if x is null, where the column's source exists for the row; null where it doesn't.

    This tells "none of it" from "not known": only the first is an observed zero.
    """
    return F.when(known, F.coalesce(x, F.lit(0.0)))


def is_missing(x: Column) -> Column:
    """1 for a missing value, else 0."""
    return F.isnull(x).cast("int")


def classify(p: Column, threshold: float = 0.5) -> Column:
    """1 at the threshold or above; null stays null."""
    return (p >= F.lit(threshold)).cast("int")


def as_supplied(value: Column, basis: Column, accepted: str = "as_supplied") -> Column:
    """A reading of the product as supplied; any other basis gives null, never an estimate."""
    return F.when(basis == F.lit(accepted), value)


def ph_extreme(ph: Column, low: float = 2.0, high: float = 11.5) -> Column:
    """Whether a pH lies at the ends where additivity doesn't hold; null for a missing pH."""
    return (ph <= F.lit(low)) | (ph >= F.lit(high))


def pattern_flags(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """A 0/1 column for each named pattern; null text gives null."""
    return {name: F.regexp_like(text, F.lit(p)).cast("int") for name, p in patterns.items()}


def hash_class(text: Column, classes: int) -> Column:
    """A class 0..classes-1 from the first 32 bits of the md5 of a text, alike in every engine."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(classes)).cast("int")
