"""Session defaults and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallowgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tallowgrid-warehouse-"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store Spark can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in tests, is a local
    folder made and set; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.mkdtemp(prefix="tallowgrid-"), "shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Rows written once to the shared folder and read from there.

    For plans that use one costly narrow table several times: it is computed once, its lineage is cut,
    and a lost executor takes nothing with it.
    """
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a table of any size is sorted or grouped by a key.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, key: str, n: int, most: int | None = None) -> DataFrame:
    """df, of ``n`` rows, dealt by a key into tasks of about ``most`` rows: windows and groups by the key need no other
    shuffle, and a task's memory stays as it is when the table grows. Left to itself Spark joins shuffled pieces by their
    compressed bytes, whatever they unpack to. Not for keys of which one may have very many rows.
    """
    parts = -(-n // (most or TASK_ROWS))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), key) if parts > 1 else df
