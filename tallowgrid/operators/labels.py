"""Label layers: canonical labels, conflicts, overlays, ledgers and projections to jurisdictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Rows of all submissions by column name; a column that one lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fold_skeletons(substances: DataFrame, skeleton: Column, category: str) -> DataFrame:
    """One row a skeleton: how many substances, and how many different categories, it folds."""
    return substances.groupBy(skeleton.alias("skeleton")).agg(F.count("*").alias("n"), F.count_distinct(category).alias("n_type"))


def folded_rows(substances: DataFrame, key: str, skeleton: str, category: str, order: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a skeleton, and the ledger of conflicts.

    A folded row has the number of substances, the smallest key, the mean of each value that is known, and the
    category; where substances disagree, that which comes first in ``order`` (the most severe), flagged by
    ``conflict``. The ledger keeps every substance of such skeletons with its category and whether it decided. All
    sums are made within tasks first; a skeleton may fold any number of substances.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    known = F.when(F.col(category).isNotNull() & (rank > 0), rank)
    folded = substances.groupBy(skeleton).agg(
        F.count("*").alias("n"), F.min(key).alias(f"first_{key}"), *[F.avg(v).alias(v) for v in values], F.min(known).alias("__least"), (F.coalesce(F.min(known) < F.max(known), F.lit(False))).alias("conflict")
    )
    folded = folded.withColumn(category, F.get(F.array(*map(F.lit, order)), F.col("__least") - 1)).drop("__least")
    torn = folded.where("conflict").select(skeleton, F.col(category).alias("__final"))
    ledger = substances.where(known.isNotNull()).select(key, skeleton, category).join(torn, skeleton)
    return folded, ledger.select(skeleton, key, category, (F.col(category) == F.col("__final")).alias("decided"))


def conflicts(substances: DataFrame, skeleton: Column, category: str) -> DataFrame:
    """Skeletons whose substances disagree, with the categories in order."""
    names = F.array_join(F.sort_array(F.collect_set(category)), ",")
    return substances.groupBy(skeleton.alias("skeleton")).agg(F.count_distinct(category).alias("__n"), names.alias("categories")).where("__n > 1").drop("__n")


def apply_overlay(base: DataFrame, overlay: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """The survey fills what the original lacks; an original value is never changed.

    Adds ``<column>_final`` and ``source`` (original, survey, or null for still unknown).
    """
    side = overlay.select(key, F.col(value).alias("__survey"))
    source = F.when(F.col(column).isNotNull(), "original").when(F.col("__survey").isNotNull(), "survey")
    joined = base.join(side, key, "left")
    return joined.withColumn(f"{column}_final", F.coalesce(column, "__survey")).withColumn("source", source).drop("__survey")


def apply_ledger(base: DataFrame, ledger: DataFrame, key: str, column: str, decision: str) -> DataFrame:
    """Manual decisions win over the base value: ``<column>_before`` and ``<column>_after``."""
    side = ledger.select(key, F.col(decision).alias("__decision"))
    joined = base.join(side, key, "left")
    return joined.withColumn(f"{column}_before", F.col(column)).withColumn(f"{column}_after", F.coalesce("__decision", column)).drop("__decision", column)


def project(labels: DataFrame, projection: DataFrame, category: str = "category") -> DataFrame:
    """Each label in every jurisdiction. The projection is a table of a few rows a jurisdiction, so it
    is broadcast; a category it leaves out or maps to null has no label there."""
    return labels.join(F.broadcast(projection.withColumnRenamed("category", category)), category)


def project_endpoints(labels: DataFrame, projection: DataFrame) -> DataFrame:
    """Each label in every jurisdiction, by (endpoint, category); the projection is a small literal table."""
    return labels.join(F.broadcast(projection), ["endpoint", "category"])


def consolidation_conflicts(submitted: DataFrame, key: str, category: str) -> DataFrame:
    """Keys on which submissions disagree: how many there are, and their categories in order."""
    known = submitted.where(F.col(category).isNotNull())
    names = F.sort_array(F.collect_set(category))
    found = known.groupBy(key).agg(F.count("*").alias("n_submitted"), names.alias("__names"))
    return found.where(F.size("__names") > 1).select(key, "n_submitted", F.array_join("__names", ",").alias("categories"))


def equivalent_jurisdictions(projection: DataFrame) -> DataFrame:
    """Jurisdictions whose mappings coincide: mapping, jurisdictions."""
    pair = F.concat("category", F.lit("="), F.coalesce(F.col("y").cast("string"), F.lit("excluded")))
    maps = projection.groupBy("jur").agg(F.array_join(F.sort_array(F.collect_list(pair)), ";").alias("mapping"))
    return maps.groupBy("mapping").agg(F.array_join(F.sort_array(F.collect_list("jur")), "+").alias("jurisdictions"))


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys the cache doesn't hold."""
    return wanted.join(cache, key, "left_anti")


def symmetric_difference(audited: DataFrame, declared: DataFrame, item: str) -> DataFrame:
    """Items on one side only, with the side; no rows means agreement."""
    a, b = audited.select(item), declared.select(item)
    return a.exceptAll(b).withColumn("side", F.lit("audited")).unionByName(b.exceptAll(a).withColumn("side", F.lit("declared")))
