"""Feature matrices: selection by manifest, missing-value protocols, audits of zeros and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowgrid.functions.scalars import is_missing

PROTOCOLS = ("nan0", "native", "native_restored")


def drop_features(matrix: DataFrame, names: list[str], prefixes: list[str] | None = None) -> DataFrame:
    """The matrix less a deny-list and columns that begin with a prefix."""
    return matrix.select(*[c for c in matrix.columns if c not in names and not c.startswith(tuple(prefixes or ()))])


def select_features(matrix: DataFrame, key: str, names: list[str]) -> DataFrame:
    return matrix.select(key, *[c for c in matrix.columns if c in names])


def melt(matrix: DataFrame, key: str) -> DataFrame:
    """key, feature, value: the matrix in long form, in one pass and without a shuffle."""
    return matrix.unpivot(key, [c for c in matrix.columns if c != key], "feature", "value")


def column_profile(matrix: DataFrame, key: str, known: str) -> DataFrame:
    """feature, n, n_zero, n_null, n_frozen_zero: zeros where ``known`` says no source exists are
    missing values that were frozen."""
    features = [c for c in matrix.columns if c not in (key, known)]
    zero = lambda c: F.col(c) == 0
    counts = [x for c in features for x in (F.count_if(zero(c)).alias(f"{c}__zero"), F.count_if(F.isnull(c)).alias(f"{c}__null"), F.count_if(zero(c) & ~F.col(known)).alias(f"{c}__frozen"))]
    sums = matrix.agg(F.count("*").alias("__n"), *counts).where("__n > 0")  # one row, and no rows times columns before it
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("__n").alias("n"), F.col(f"{c}__zero").alias("n_zero"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__frozen").alias("n_frozen_zero")) for c in features])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def dead_columns(matrix: DataFrame, key: str) -> DataFrame:
    """feature, n_distinct, dead: a column of one value, nulls aside, is dead."""
    return melt(matrix, key).groupBy("feature").agg(F.count_distinct("value").alias("n_distinct")).withColumn("dead", F.col("n_distinct") <= 1)


def column_fingerprints(matrix: DataFrame, key: str) -> DataFrame:
    """feature, fingerprint: a sum over rows of a hash of key and value, so that the order of rows and how
    they lie in tasks don't matter. Equal columns have equal ones; a null has a hash of its own."""
    cell = F.xxhash64(F.col(key), F.isnull("value"), F.col("value") + F.lit(0.0))
    return melt(matrix, key).groupBy("feature").agg(F.sum(cell.cast("decimal(20,0)")).alias("fingerprint"))


def duplicate_columns(matrix: DataFrame, key: str) -> DataFrame:
    """a, b, all_equal for each pair of columns; nulls equal nulls.

    Columns are compared by fingerprints, in one pass over the cells; only columns with the same fingerprint are
    then compared cell by cell, each with the first of its class, in a second pass. What is handled outside
    Spark's tasks is a row a column.
    """
    rows = column_fingerprints(matrix, key).collect()
    like: dict = {}
    for r in sorted(rows, key=lambda r: r["feature"]):
        like.setdefault(r["fingerprint"], []).append(r["feature"])
    asked = [(c[0], other) for c in like.values() for other in c[1:]]
    spark, kept = matrix.sparkSession, {r["feature"]: r["feature"] for r in rows}
    if asked:
        flags = matrix.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(asked)]).first()
        kept |= {b: a for i, (a, b) in enumerate(asked) if flags[f"p{i}"]}
    classes = spark.createDataFrame(sorted(kept.items()), "name string, class string")
    a, b = classes.select(F.col("name").alias("a"), F.col("class").alias("ca")), classes.select(F.col("name").alias("b"), F.col("class").alias("cb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("ca") == F.col("cb")).alias("all_equal"))


def missing_flags(matrix: DataFrame, key: str) -> DataFrame:
    return matrix.select(key, *[is_missing(F.col(c)).alias(f"{c}_isna") for c in matrix.columns if c != key])


def cell(column: str, known: str, protocol: str, frozen: list[str]) -> Column:
    """A column under a protocol: nan0 fills missing cells with 0 (a control only); native leaves
    them; native_restored also gives back the missing values that the build froze into 0."""
    if protocol == "nan0":
        return F.coalesce(F.col(column), F.lit(0.0))
    if protocol == "native":
        return F.col(column)
    if protocol == "native_restored":
        return F.when(F.col(known), F.col(column)) if column in frozen else F.col(column)
    raise ValueError(protocol)


def under_protocol(matrix: DataFrame, key: str, known: str, protocol: str, frozen: list[str]) -> DataFrame:
    """The matrix under a protocol."""
    return matrix.select(key, *[cell(c, known, protocol, frozen).alias(c) for c in matrix.columns if c not in (key, known)])


def zero_fractions(matrix: DataFrame, key: str, known: str, frozen: list[str]) -> DataFrame:
    """protocol, zero_fraction: the share of cells that are 0 under each protocol, in one pass."""
    features = [c for c in matrix.columns if c not in (key, known)]
    zeros = lambda p: sum((cell(c, known, p, frozen) == 0).cast("int") if p == "nan0" else F.coalesce((cell(c, known, p, frozen) == 0).cast("int"), F.lit(0)) for c in features)
    sums = matrix.agg(F.count("*").alias("__n"), *[F.sum(zeros(p)).alias(p) for p in PROTOCOLS])
    rows = F.array(*[F.struct(F.lit(p).alias("protocol"), (F.col(p) / (F.col("__n") * F.lit(len(features)))).alias("zero_fraction")) for p in PROTOCOLS])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def invented(built: DataFrame, raw: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose raw value is missing and whose built value isn't; no rows means none was invented."""
    side = raw.select(key, F.col(column).alias("__raw"))
    return built.select(key, column).join(side, key).where(F.isnull("__raw") & F.col(column).isNotNull()).select(key)
