"""Storage and plan helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowgrid.operators.skew import join_unique  # noqa: F401  joins that stand keys of any frequency
from tallowgrid.session import settle as materialise  # noqa: F401  rows written once to the shared folder
from tallowgrid.session import shared_root


def new_folder(spark: SparkSession, tag: str) -> str:
    """URI of a new folder, shared by driver and executors, that nothing else uses."""
    root = shared_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI: local or mounted folders, HDFS, S3 and GCS."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write a file under a temporary name, then move it in place; returns its bytes.

    A task that is run again writes anew and moves over the same or another name; readers never see a
    half-written file.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with fs.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(temporary, path)
    return size


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True for rows that learning must not see; rows without an id are never learned from."""
    return F.coalesce(crc_remainder(column, modulus) == F.lit(remainder), F.lit(True))


#: Rows of an Arrow batch that hold whole texts: with the longest texts it bounds a worker's memory.
TEXT_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have TEXT_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


#: What a worker remembers from task to task, by operator.
CACHES: dict[str, dict] = {}


def lean(task, own: str = ""):
    """A task that first drops what other operators left in the worker, and gives freed memory back at
    its end: workers live on, and share an executor's memory."""

    def run(batches):
        for name, held in CACHES.items():
            if name != own:
                held.clear()
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it has


def map_texts(docs: DataFrame, columns: list[str], text: str, make, schema: str) -> DataFrame:
    """Columns of docs with what ``make()(texts)`` finds for the batch's texts appended.

    ``make`` runs once a task and returns a function from a list of texts to arrays; ``schema`` names
    and types them.
    """
    bound_batches(docs.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]
    rows = docs.select(*columns, F.col(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches):
        find = make()
        for batch in batches:
            if batch.num_rows:
                found = find(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*batch.schema.names[:-1], *names])

    return rows.mapInArrow(lean(run), f"{kept}, {schema}")


def keep_texts(docs: DataFrame, make, text: str = "text") -> DataFrame:
    """Rows of docs, all columns as they are, for whose texts ``make()(texts)`` is true."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        find = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(find(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def agreed_labels(labels: DataFrame, name: str) -> DataFrame:
    """doc_id and label of the documents whose label rows are not null and agree."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(name).cast("int").alias("label"), F.max(name).cast("int").alias("__most"))
        .where(F.col("label") == F.col("__most"))
        .drop("__most")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, modulus: int, remainder: int, each: int) -> DataFrame:
    """doc_id, text, label of at most ``each`` rows a label, never held out; the same rows every time.

    The rows are those with the smallest hashes of their ids, so the sample is spread over all rows; of
    rows that share an id, that with the smallest hash of its text. It is written once and read as often
    as a fit needs it.
    """
    known = agreed_labels(labels, name).where(~held_out("doc_id", modulus, remainder)).join(docs.select("doc_id").distinct(), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("label") == F.lit(v)).orderBy(*order).limit(each) for v in (0, 1)]
    # At most 2 * each ids: small by parameter, so this side may be broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return materialise(one.select("doc_id", F.col("first.text").alias("text"), "label"), "labelled-sample")


def logistic(features: np.ndarray, target: np.ndarray, ridge: float = 1e-2, rate: float | None = None) -> dict:
    """Ridge logistic regression by Newton's method on standardised features.

    ``rate``: the share of label 1 that the rows are weighted to have.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    have = min(max(target.mean(), 1e-3), 1 - 1e-3)
    want = have if rate is None else min(max(rate, 1e-3), 1 - 1e-3)
    weight = np.where(target == 1, want / have, (1 - want) / (1 - have))
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(target))
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (target - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


def probability(model: dict, features: np.ndarray) -> np.ndarray:
    z = model["beta"][0] + ((features - model["mean"]) / model["scale"]) @ model["beta"][1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
