"""Lookups by key with a cache that grows; fetching stays outside the engine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowgrid.operators.labels import misses
from tallowgrid.session import settle


def split_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the cache answers, and the keys it misses, to be fetched."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(cache, key), misses(keys, cache, key)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that of the greatest ``order``, on ties of the greatest remaining columns. Rows are folded within tasks first."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("__row")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col("__row")[c].alias(c) for c in (order, *rest)]).select(*rows.columns)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache's rows, or None before the first upsert."""
    try:
        return spark.read.parquet(path).drop("__bucket")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert(updates: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> None:
    """Put updates into the cache: for each key the row of the greatest ``order`` stays; null keys are left out.

    The cache is partitioned by buckets of the key's hash. Only buckets that updates touch are read, merged and
    written over, by Spark's dynamic partition overwrite; what is merged is written aside first, so nothing is read
    from a folder that is being replaced. Updates that come again, or older ones, change nothing: a job that
    broke off is run again as it was.
    """
    spark = updates.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    fresh = settle(latest(updates, key, order).withColumn("__bucket", bucket), "updates")
    touched = [r[0] for r in fresh.select("__bucket").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return
    merged = fresh
    if read_cache(spark, path) is not None:
        held = spark.read.parquet(path).where(F.col("__bucket").isin(*touched))
        both = held.select(*fresh.columns).unionByName(fresh)
        merged = settle(latest(both.drop("__bucket"), key, order).withColumn("__bucket", bucket), "merged")
    merged.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
