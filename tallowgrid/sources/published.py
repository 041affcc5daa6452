"""Tables that are published only if the pass that writes them finds no fault."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallowgrid.operators.checks import Violation

_MANIFEST = "version long, folder string, fields string, n long, at timestamp"
_BROKEN = "__broken"


def versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The manifest of a name: version, folder, fields, n, at; no rows before the first publication."""
    path = f"{root.rstrip('/')}/manifest/{name}"
    spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


def _written(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(_BROKEN, "boolean")).parquet(folder)


def publish(df: DataFrame, root: str, name: str, rules: dict[str, Column]) -> int:
    """Write df, and publish it as the next version of ``name`` if no row breaks a rule; returns the version.

    A rule is a condition that no row may meet. The rules are decided in the pass that writes, so the data are scanned
    once: rows that break one are written to a partition of their own, which is all that is read to count them. (Spark's
    ``observe`` would count them too, but in Spark 4.1 a session that has used an Observation can no longer run its
    own fitted forests.) The folder is named by no manifest; only when that partition is empty does a row of the
    manifest name it, so readers see a whole clean version or the one before. With a violation ``checks.Violation``
    is raised, with the counts, and nothing is published. A rule that is null for a row isn't broken by it. One job
    at a time may publish a name.
    """
    if "/" in name or name in ("", ".", ".."):
        raise ValueError("a name is a single path segment")
    if _BROKEN in df.columns:
        raise ValueError(f"{_BROKEN} is a reserved column")
    spark, folder = df.sparkSession, f"{root.rstrip('/')}/data/{name}/{uuid.uuid4().hex}"
    broken = reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in rules.values()], F.lit(False))
    df.withColumn(_BROKEN, broken).write.partitionBy(_BROKEN).parquet(folder)
    written = _written(spark, folder, df.schema)
    found = written.where(_BROKEN).agg(F.count("*").alias("__n"), *[F.count_if(c).alias(r) for r, c in rules.items()]).first()
    if found["__n"]:
        counts = {r: found[r] for r in rules if found[r]}
        raise Violation(f"{name} is not published: " + ", ".join(f"{r}: {n} rows" for r, n in counts.items()), counts)
    last = versions(spark, root, name).agg(F.max("version")).first()[0]
    row = [((last or 0) + 1, folder, df.schema.json(), written.count())]  # counted from the files' footers
    manifest = spark.createDataFrame(row, "version long, folder string, fields string, n long").withColumn("at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest/{name}")
    return row[0][0]


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The last published version, or a given one; LookupError if there is none."""
    rows = versions(spark, root, name)
    rows = rows.where(F.col("version") == version) if version is not None else rows
    found = rows.orderBy(F.desc("version")).first()
    if found is None:
        raise LookupError(f"no published version of {name}")
    return _written(spark, found["folder"], StructType.fromJson(json.loads(found["fields"]))).drop(_BROKEN)
