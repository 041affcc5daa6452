"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import agreed_labels, held_out, keep_texts, labelled_sample, lean, logistic, map_texts, probability

MODULUS, REMAINDER = 4, 2
#: Scales at which a text is compared with either kind: bytes of a block, of a dictionary, and of the
#: segments that dictionaries are trained from. Small blocks tell words apart, large ones repetition.
SCALES = ((1024, 32768, 200), (256, 32768, 64), (64, 65536, 64))

#: Blocks as long as a segment without which no dictionary is trained: the trainer holds a quarter back
#: and needs several of the rest.
FEW = 16


def _chunks(content: bytes, size: int) -> list[bytes]:
    """A text in blocks short enough that the dictionary counts; together they are the whole text."""
    return [content[i : i + size] for i in range(0, len(content), size)] or [b""]


class CompressionScorer:
    """Score of a text from its compressed sizes with the dictionaries of bad and of good text."""

    def __init__(self, model: dict):
        self.model = model
        self.by = []
        for pair in model["dictionaries"]:
            self.by.append([])
            for content in pair:
                dictionary = zstandard.ZstdCompressionDict(content)
                dictionary.precompute_compress(level=3)
                self.by[-1].append(zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> list[float]:
        """For each scale the normalised difference (bad - good) / (bad + good) of compressed sizes: of the
        whole text, and the mean, least and largest of its blocks."""
        content, out = text.encode("utf-8", "replace"), []
        for (size, _, _), (bad, good) in zip(SCALES, self.by, strict=True):
            blocks = _chunks(content, size)
            b, g = (np.array([len(c.compress(x)) for x in blocks], dtype=np.float64) for c in (bad, good))
            each = (b - g) / (b + g)
            out += [(b.sum() - g.sum()) / (b.sum() + g.sum()), each.mean(), each.min(), each.max()]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return probability(self.model["calibration"], np.array([self.features(t or "") for t in texts]))


class ConstantScorer:
    """What there is without both labels: the same score for every text."""

    def __init__(self, model: dict):
        self.score = model["constant"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.score)


def scorer(model: dict):
    return CompressionScorer(model) if "dictionaries" in model else ConstantScorer(model)


def fit(docs: DataFrame, labels: DataFrame, each: int = 8000, most_bytes: int = 64 << 20) -> dict:
    """Dictionaries from one half of the sampled rows, the calibration from the other half.

    ``each`` bounds the labelled rows learned from, for each label; of these whole texts are used. A
    label's dictionaries are trained in one task from all blocks of its half, which ``most_bytes`` bounds:
    rows, in the order of their hashes, that would go beyond it are not trained from (a first row always
    is). The driver gets the dictionaries and a row of differences for each row of the other half, however
    long its text. No rows give a constant; further columns are not read. Held-out rows and rows with
    conflicting labels are never learned from. Without rows of both labels the model is a constant: 1 or 0
    for the one label there is, 0.5 for none.
    """
    sample = labelled_sample(docs, labels, "quality", MODULUS, REMAINDER, each)
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))

    def train(key, rows):
        texts = [t.encode("utf-8", "replace") for t in rows["text"]]
        found = [dictionary([c for t in texts for c in _chunks(t, size)], most, segment) for size, most, segment in SCALES]
        return pd.DataFrame({"label": [int(key[0])] * len(found), "scale": range(len(found)), "content": found})

    upto = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = sample.where(half == 0).select("doc_id", "label", F.octet_length("text").cast("long").alias("bytes")).withColumn("upto", upto)
    within = sizes.where((F.col("upto") <= most_bytes) | (F.col("upto") == F.col("bytes"))).select("doc_id")
    # At most 2 * each ids: small by parameter, so this side may be broadcast.
    trained = sample.join(F.broadcast(within), "doc_id").select("label", "text").groupBy("label").applyInPandas(train, "label int, scale int, content binary")
    by = {(r["label"], r["scale"]): bytes(r["content"]) for r in trained.collect()}
    labels_seen = {label for label, _ in by}
    if labels_seen != {0, 1}:
        return {"constant": float(max(labels_seen)) if labels_seen else 0.5}
    model: dict = {"dictionaries": [[by[v, k] for v in (0, 1)] for k in range(len(SCALES))]}

    def measured(batches):
        own = CompressionScorer(model)
        for batch in batches:
            found = [own.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "features"])

    seen = sample.where(half == 1).select("text", "label").mapInArrow(lean(measured), "label int, features array<double>").toPandas()
    target = seen["label"].to_numpy()
    if len(set(target)) < 2:
        return {"constant": 0.5}
    order = np.lexsort(np.array(seen["features"].tolist()).T)
    features = np.array(seen["features"].tolist())[order]
    # Rows are sampled by label, so each label's share among all labelled rows is set right again.
    rate = agreed_labels(labels, "quality").where(~held_out("doc_id", MODULUS, REMAINDER)).agg(F.avg("label")).first()[0]
    model["calibration"] = logistic(features, target[order], ridge=1e-4, rate=rate)
    return model


def dictionary(pool: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary, the same for a pool in any order; of fewer than FEW blocks that hold a
    segment, their own text. A training that fails for another reason raises."""
    pool = sorted(pool)
    if sum(len(x) >= segment for x in pool) < FEW:
        return b"".join(pool)[-size:] or b"\0" * 8
    return zstandard.train_dictionary(size, pool, k=segment, d=8).as_bytes()


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get a score too.

    Whole texts are compressed, however long. Repeated rows are each scored; rows without an id count as
    held out; no rows give none; further columns, whatever their names, are not read.
    """
    found = map_texts(docs, ["doc_id"], "text", lambda: lambda texts, own=scorer(model): [own.scores(texts)], "score double")
    return found.select(
        "doc_id",
        held_out("doc_id", MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns kept, whose score reaches the threshold.

    Null and empty texts have a score like others; repeated rows are each judged; no rows give none.
    """
    return keep_texts(docs, lambda: lambda texts, own=scorer(model): own.scores(texts) >= threshold)
