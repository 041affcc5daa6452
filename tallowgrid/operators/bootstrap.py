"""Grouped Poisson bootstrap of metrics, paired between arms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowgrid.operators.metrics import COUNTS, mcc_of


def poisson_cuts(upto: int = 7) -> list[float]:
    """The distribution function of a Poisson variable of mean 1 at 0, 1, and so on, to nine places."""
    total, out = 0.0, []
    for k in range(upto + 1):
        total += math.exp(-1) / math.factorial(k)
        out.append(round(total, 9))
    return out


def poisson_weight(text: Column) -> Column:
    """A Poisson weight of mean 1 from the first 32 bits of the md5 of a text: reruns and engines agree."""
    return weight_of(uniform(text))


def uniform(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def weight_of(u: Column) -> Column:
    return sum(((u >= c).cast("int") for c in poisson_cuts()), F.lit(0))


def replicated_counts(rows: DataFrame, group: str, y: str, pred: str, by: list[str], replicates: int) -> DataFrame:
    """by, b, and the confusion counts of each replicate b, 1 and up; b = 0 has every row once.

    A group's weight is drawn once a replicate, from its name, and is alike in all arms: differences between
    arms are paired, and rows of a group stay together. Rows are summed to a row for each group, arm and cell of
    the confusion first; only those are written for each replicate, and their sums are made within tasks.
    """
    known = rows.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    of = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1))
    cells = known.groupBy(*by, group).agg(of(1, 1).alias("tp"), of(0, 0).alias("tn"), of(0, 1).alias("fp"), of(1, 0).alias("fn"))
    # A group's cells, one an arm, are together while its weights are drawn.
    own = cells.groupBy(group).agg(F.collect_list(F.struct(*by, *COUNTS)).alias("__cells"))
    spread = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    name = F.concat(F.col(group).cast("string"), F.lit(":"), F.col("b").cast("string"))
    drawn = spread.withColumn("__u", uniform(name)).withColumn("__w", F.when(F.col("b") == 0, 1).otherwise(weight_of(F.col("__u"))))
    flat = drawn.select("b", "__w", F.explode("__cells").alias("__c")).select("b", "__w", "__c.*")
    return flat.groupBy(*by, "b").agg(*[F.sum(F.col(c) * F.col("__w")).alias(c) for c in COUNTS])


def paired_deltas(counts: DataFrame, key: list[str], arm: str, base: str) -> DataFrame:
    """key, b, arm, value, delta: each replicate's mcc less the base arm's of the same replicate."""
    found = counts.select(*key, "b", arm, mcc_of(*[F.col(c) for c in COUNTS]).alias("value"))
    held = found.where(F.col(arm) == base).select(*key, "b", F.col("value").alias("__base"))
    return found.where(F.col(arm) != base).join(held, [*key, "b"]).select(*key, "b", arm, "value", (F.col("value") - F.col("__base")).alias("delta"))


def verdicts(deltas: DataFrame, key: list[str], arm: str, tail: float = 0.025) -> DataFrame:
    """key, arm, delta, low, high, replicates, inside: the delta of all rows, its interval over replicates (percentiles
    by linear interpolation), and whether no difference, 0, lies inside it. Replicates without an mcc are left out."""
    drawn = F.when(F.col("b") > 0, F.col("delta"))
    out = deltas.groupBy(*key, arm).agg(
        F.max(F.when(F.col("b") == 0, F.col("delta"))).alias("delta"), F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high"), F.count(drawn).alias("replicates")
    )
    return out.withColumn("inside", (F.col("low") <= 0) & (F.col("high") >= 0))
