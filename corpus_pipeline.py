"""Corpus pipeline: documents to packed sequences.

Counted as part of the subpackage llm. Each stage takes (spark, docs, sf_dir) and works on all that
the one before kept; all but the last return the columns of documents. In every stage: whole texts count,
however long; null and empty texts, repeated rows and rows that share an id are judged row by row unless
the stage says otherwise; further columns are kept and never read; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallowgrid.llm import jaccard, language, mixing, quality, tokens
from tallowgrid.llm.common import materialise
from tallowgrid.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.7 or more).

    Null texts are scored as empty ones. Without labels of both kinds the score is the same for all: every
    row goes, unless all labels are good.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from this stage's input, by a score of 0.3 or more.

    Null texts, texts without a letter, letter noise and texts in no learned language go.
    """
    return language.keep_identified(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that links of 75 % of shingles make.

    Null texts and texts without a word link with nothing and all stay; of repeated rows one stays; a group
    without any id keeps one row.
    """
    return jaccard.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: each document as often as it is taken.

    Documents without a word have nothing to give and go; a null source is a source.
    """
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; workers that other stages used keep less in mind.

    A null text is its end id alone.
    """
    return tokens.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=350_000)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, rank-order profiles and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
