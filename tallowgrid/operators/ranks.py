"""Global ranks and running sums without bringing all rows to one task.

Rows are dealt by ranges of the order, which Spark draws from a sample, so a task holds a like share of
rows whatever the values are. The dealt rows are written once; windows without a key see a row for each
range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.session import settle


def _ranged(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """df in ranges of the order, numbered by __block."""
    return settle(df.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()), tag)


def global_row_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Row number (from 1) by the columns of ``order``, which together tell rows apart."""
    rows = _ranged(df, order, "ranks")
    counts = rows.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__block", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    # A row for each range: as many as there are shuffle partitions.
    return rows.join(F.broadcast(starts), "__block").withColumn(out, F.col("__start") + own).drop("__block", "__start")


def equal_bins(df: DataFrame, bins: int, value: str, key: str, out: str) -> DataFrame:
    """The ``bins`` bins of nearly equal size by (value, key) that ntile gives; larger ones first."""
    n = df.agg(F.count("*").alias("__n"))
    rows = global_row_number(df, [value, key], "__at").join(F.broadcast(n))  # one row
    size, more = F.floor(F.col("__n") / bins), F.col("__n") % bins
    edge = more * (size + 1)
    first = F.floor((F.col("__at") - 1) / (size + 1))
    rest = more + F.floor((F.col("__at") - edge - 1) / F.greatest(size, F.lit(1)))
    return rows.withColumn(out, (F.when(F.col("__at") <= edge, first).otherwise(rest) + 1).cast("int")).drop("__at", "__n")


def running_before(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """For rows unique in (by, value): the sums over rows of smaller value, as ``<name>_before``."""
    rows = _ranged(counts, [*by, value], "running")
    block = rows.groupBy(*by, "__block").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__block").alias("__at"), *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}") for s in sums])
    within = Window.partitionBy(*by, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__block") == F.col("__at")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    rows = rows.join(block, same)
    return rows.select(*counts.columns, *[(F.coalesce(F.sum(s).over(within), F.lit(0)) + F.col(f"__{s}")).alias(f"{s}_before") for s in sums])
