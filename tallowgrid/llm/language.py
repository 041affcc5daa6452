"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import bound_batches, held_out, keep_texts, lean, map_texts

MODULUS, REMAINDER = 5, 0
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MARK = ord("_")


def ngram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of words, each padded by a mark on both sides.

    A code packs three code points of 21 bits; no two n-grams share one. Codes ascend.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = list(words)
    points = np.frombuffer(("_" + "_".join(names) + "_").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    letter = points != _MARK
    weight = np.zeros(len(points), np.int64)
    weight[letter] = np.repeat(np.fromiter(words.values(), np.int64, len(names)), [len(w) for w in names])
    codes, counts = [points[letter]], [weight[letter]]
    pair = points[:-1] | points[1:] << 21
    codes.append(pair)
    counts.append(np.maximum(weight[:-1], weight[1:]))
    # A pair has one letter at least; where both are letters they are of one word.
    middle = letter[1:-1]
    triple = (pair[:-1] | points[2:] << 42)[middle]
    codes.append(triple)
    counts.append(weight[1:-1][middle])
    flat, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return flat, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(flat)).astype(np.int64)


def only_letters(words: Counter) -> Counter:
    """Words cut at what is no letter: the pattern takes numerals that are no digits for letters."""
    for w in [w for w in words if not w.isalpha()]:
        n = words.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            words[part] += n
    return words


def words_of(text: str) -> Counter:
    return only_letters(Counter(_WORD.findall(text.lower())))


def fit(docs: DataFrame, size: int = 300) -> dict:
    """Profiles: for each language its ``size`` most frequent n-grams in order, ties by code.

    Learned from every row that has text and a language and is not held out. Counts are summed within
    a task before they are shuffled; a profile row is kept for each rank only, so what reaches the
    driver is languages x size.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", MODULUS, REMAINDER)).select("lang", "text")

    def count(batches):
        held: dict[str, Counter] = {}

        def flush():
            for lang, words in held.items():
                codes, counts = ngram_counts(only_letters(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            if sum(map(len, held.values())) > 40_000:
                yield from flush()
        yield from flush()

    summed = rows.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    # Each task's rows are cut to ranks in reach before they meet, by the sort the window needs.
    top = summed.withColumn("rank", rank).where(F.col("rank") <= size).toPandas()
    langs = sorted(set(top["lang"]))
    codes = np.unique(top["code"].to_numpy(dtype=np.int64)) if len(top) else np.zeros(0, np.int64)
    ranks = np.full((len(codes) + 1, len(langs)), size, dtype=np.int32)
    if len(top):
        ranks[np.searchsorted(codes, top["code"].to_numpy(dtype=np.int64)), [langs.index(x) for x in top["lang"]]] = top["rank"] - 1
    return {"langs": langs, "codes": codes, "ranks": ranks, "size": size}


def identify(model: dict, text: str | None) -> tuple[str, float]:
    """Language and 1 minus the normalised distance to its profile; ties go to the first name."""
    if not text or not model["langs"]:
        return UNDETERMINED, 0.0
    words = words_of(text)
    if not words:
        return UNDETERMINED, 0.0
    size = model["size"]
    codes, counts = ngram_counts(words)
    own = codes[np.argsort(-counts, kind="stable")[:size]]
    at = np.searchsorted(model["codes"], own)
    at[at == len(model["codes"])] = 0
    at = np.where(model["codes"][at] == own, at, len(model["codes"]))
    theirs = model["ranks"][at]
    apart = np.abs(theirs - np.arange(len(own), dtype=np.int32)[:, None])
    apart[theirs == size] = size
    distance = apart.sum(axis=0)
    best = int(distance.argmin())
    return model["langs"][best], float(1 - distance[best] / (size * len(own)))


def identify_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Null texts and texts without a letter are ``und`` with score 0, as is every text where no language
    could be learned. Whole texts count, whatever their length; repeated rows are each identified; no rows
    give none; further columns, whatever their names, are not read.
    """

    def make():
        def find(texts):
            found = [identify(model, t) for t in texts]
            return [x for x, _ in found], [s for _, s in found]

        return find

    found = map_texts(docs, ["doc_id"], "text", make, "lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The documents, all columns kept, whose language is determined with a score of ``least`` at least.

    Letter noise and texts in no learned language lie far from every profile: random letters score about
    0.2, another script 0, while texts of a learned language score 0.38 or more on the test tables.
    Null texts and texts without a letter go; repeated rows are each judged; whole texts count; no rows
    give none; where no language was learned every row goes.
    """

    def make():
        def find(texts):
            found = [identify(model, t) for t in texts]
            return [lang != UNDETERMINED and score >= least for lang, score in found]

        return find

    return keep_texts(docs, make)
