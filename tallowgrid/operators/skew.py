"""Joins that stand keys of any frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.session import settle

#: Rows a key may have before a join splits it off, and the most keys that may then be broadcast.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 100_000


def join_unique(rows: DataFrame, side: DataFrame, key: str, how: str = "left", n: int | None = None) -> DataFrame:
    """rows with the columns of ``side``, which has one row a key; nulls are a key; left or inner.

    A key with more than HEAVY_ROWS rows, or more than one in HEAVY_KEYS of all, is split off and broadcast:
    there can't be more than HEAVY_KEYS of those. No other key has more rows than that, so none is hot
    in the shuffle of the rest. ``rows`` is read three times and is best a written table, unless ``n``, a bound
    of its rows that is known already, shows that no key can be heavy.
    """
    n = rows.count() if n is None else n
    most = max(HEAVY_ROWS, -(-n // HEAVY_KEYS))
    named = side.withColumnRenamed(key, "__side")

    def meet(part: DataFrame, other: DataFrame) -> DataFrame:
        return part.join(other, part[key].eqNullSafe(other["__side"]), how).drop("__side")

    if n <= most:
        return meet(rows, named)
    heavy = rows.groupBy(F.col(key).alias("__heavy")).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__heavy")
    hot = F.broadcast(settle(heavy, "heavy-keys"))
    few = named.join(hot, named["__side"].eqNullSafe(hot["__heavy"]), "left_semi")
    own = rows.join(hot, rows[key].eqNullSafe(hot["__heavy"]), "left_semi")
    rest = rows.join(hot, rows[key].eqNullSafe(hot["__heavy"]), "left_anti")
    return meet(own, F.broadcast(few)).unionByName(meet(rest, named))
