"""Registered queries of the operators: production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowgrid.llm import codes, credentials, hosts, jaccard, language, mixing, mtree, quality, tokens, toxicity, trie, warc
from tallowgrid.session import table


def op1_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_documents(docs, language.fit(docs))


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_shards(manifest)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_documents(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op11_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


def op12_contracted_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_net_drift_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_zip_warc": op1_zip_warc,
    "op2_rank_order_language": op2_rank_order_language,
    "op3_cost_balanced_packing": op3_cost_balanced_packing,
    "op4_weighted_mix": op4_weighted_mix,
    "op5_compression_quality": op5_compression_quality,
    "op6_mtree_top_k": op6_mtree_top_k,
    "op7_lexicon_toxicity": op7_lexicon_toxicity,
    "op8_token_shards": op8_token_shards,
    "op9_host_rules": op9_host_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_linked_credentials": op11_linked_credentials,
    "op12_contracted_trie": op12_contracted_trie,
    "op13_net_drift_codes": op13_net_drift_codes,
}
ORACLES: dict[str, str] = {
    "op1_zip_warc": warc.ORACLE_SQL,
    "op4_weighted_mix": mixing.ORACLE_SQL,
    "op6_mtree_top_k": mtree.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op9_host_rules": hosts.ORACLE_SQL,
    "op11_linked_credentials": credentials.ORACLE_SQL,
    "op12_contracted_trie": trie.ORACLE_SQL,
    "op13_net_drift_codes": codes.ORACLE_SQL,
}
