"""Immutable originals, CSV with fixed schemas, isolated outputs and archives."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallowgrid.session import settle


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 of every file: compared with stored hashes, it proves originals unchanged.

    A file is read in pieces of 1 MB, so its size isn't bounded by a row or by memory; a file is a task. A SHA-256 takes
    bytes in their order, so one task reads a whole file: ``tree_hashes`` are for many tasks. Stores that Arrow has no
    file system for are read by Spark, a file a row.
    """
    found = _listed(spark, path, pattern)
    files, one = found.count(), found.first()
    try:
        if one:
            open_file(one["path"]).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # no such scheme
        whole = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        return whole.select("path", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            uris, sizes = (c.to_pylist() for c in batch.columns)
            digests = [_digest(uri, 0, size).hex() for uri, size in zip(uris, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])

    return found.repartition(max(files, 1)).mapInArrow(run, "path string, sha256 string")


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length of every file; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def _digest(uri: str, start: int, size: int) -> bytes:
    """The SHA-256 of ``size`` bytes of a file, of which 1 MB is held."""
    digest, left = hashlib.sha256(), size
    with open_file(uri) as f:
        f.seek(start)
        while left > 0 and (piece := f.read(min(left, 1 << 20))):
            digest.update(piece)
            left -= len(piece)
    if left > 0:
        raise OSError(f"{uri} ended {left} bytes before its length")
    return digest.digest()


def open_file(uri: str):
    """A file of any store that Arrow opens, for reading ranges of it."""
    fs, path = (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


#: Bytes of a range, and digests that one digest of the level above joins.
RANGE, FAN = 64 << 20, 1024


def range_hashes(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE) -> DataFrame:
    """path, level 0, at, digest: the SHA-256 of each range of ``size`` bytes of every file; Spark lists no empty files.

    A range is a row, so a file of any size is read by as many tasks as it has ranges; a task holds 1 MB of it.
    """
    ranges = _listed(spark, path, pattern).select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("at"))

    def run(batches):
        for batch in batches:
            digests = [_digest(uri, at * size, min(size, length - at * size)) for uri, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(digests), pa.int32()), batch.column(2), pa.array(digests, pa.binary())], names=["path", "level", "at", "digest"])

    return ranges.repartition(F.col("path"), F.col("at")).mapInArrow(run, "path string, level int, at long, digest binary")


def tree_hashes(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """path, level, at, digest of every level: up to ``fan`` digests in order are hashed into one, until a file has one.

    No task holds more than ``fan`` digests of a file. The root doesn't depend on how ranges lie in tasks, and two
    trees differ in the leaves that changed and on their paths to the root only (see ``changed_ranges``).
    """
    level = settle(leaves, "leaves")
    levels, k = [level], 0
    while True:
        k += 1
        up = level.groupBy("path", F.floor(F.col("at") / fan).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("__all"))
        joined = F.aggregate("__all", F.lit(b""), lambda acc, x: F.concat(acc, x["digest"]))
        level = settle(up.select("path", F.lit(k).alias("level"), "at", F.unhex(F.sha2(joined, 256)).alias("digest")), "digests")
        levels.append(level)
        if level.where("at > 0").isEmpty():
            return reduce(DataFrame.unionByName, levels)


def roots(tree: DataFrame) -> DataFrame:
    """path, sha256: the digest of each file's highest level, in lowercase hex."""
    top = F.max(F.struct("level", "digest"))
    return tree.groupBy("path").agg(top.alias("__top")).select("path", F.lower(F.hex("__top.digest")).alias("sha256"))


def changed_ranges(now: DataFrame, stored: DataFrame) -> DataFrame:
    """path, at of the ranges whose digests differ or that one tree lacks; only files whose roots differ are compared."""
    files = changed_files(roots(now), roots(stored))
    a = now.where("level = 0").join(files, "path", "left_semi").select("path", "at", F.col("digest").alias("a"))
    b = stored.where("level = 0").join(files, "path", "left_semi").select("path", "at", F.col("digest").alias("b"))
    return a.join(b, ["path", "at"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", "at")


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths whose hash differs or that lie on one side only; no rows means unchanged."""
    joined = now.select("path", F.col("sha256").alias("a")).join(stored.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return joined.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema: an all-null column keeps its type."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def read_csv_split(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows by the schema, and rejected lines: file, line, reason.

    One PERMISSIVE read, written once with the raw text of lines that don't fit; nothing is dropped and nothing
    stops. A reason names what is wrong: fields missing, fields too many, or the first column whose text is no
    value of its type.
    """
    raw = StructType([*schema.fields]).add("__raw", StringType())
    read = spark.read.schema(raw).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__raw").csv(path)
    rows = settle(read.select("*", F.col("_metadata.file_name").alias("__file")), "lines")
    texts = StructType()
    for f in schema.fields:
        texts = texts.add(f.name, StringType())
    for extra in ("__more", "__end"):
        texts = texts.add(extra, StringType())
    # A field of its own ends each line, so that empty last fields can be told from missing ones.
    parsed = F.from_csv(F.concat("__raw", F.lit(",|")), texts.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"})
    names = [f.name for f in schema.fields]
    reason = F.when(F.col("__p.__more").isNull(), "fields missing").when(F.col("__p.__more") != "|", "fields too many")
    for f in schema.fields:
        value = F.col("__p")[f.name]
        reason = reason.when(value.isNotNull() & F.col("__p")[f.name].try_cast(f.dataType).isNull(), f"{f.name} is no {f.dataType.simpleString()}")
    bad = rows.where(F.col("__raw").isNotNull()).select("__file", "__raw", parsed.alias("__p"))
    return rows.where(F.col("__raw").isNull()).select(*names), bad.select(F.col("__file").alias("file"), F.col("__raw").alias("line"), reason.otherwise("unreadable").alias("reason"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def write_output(df: DataFrame, root: str, job: str, name: str) -> str:
    """A job writes below its own folder only, and never over what is there."""
    if "/" in job or "/" in name or job in ("", ".", ".."):
        raise ValueError("a job and a name are single path segments")
    path = f"{root.rstrip('/')}/{job}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def archive(df: DataFrame, root: str, name: str, prefix: str, key: str) -> str:
    """Freeze the columns of a retired endpoint, with the key, without using them."""
    return write_output(df.select(key, *[c for c in df.columns if c.startswith(prefix)]), root, "archive", name)
