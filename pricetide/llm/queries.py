"""The registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import hnsw, huffman, lm_score, mixing, ngram_join, packing, phrases, pii, quality, resample, secret_scan, topk, toxicity
from .common import Scratch, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), WORD_BPE)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(spark, table(spark, sf_dir, "documents"), good)


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'token-ids').base}/corpus"
    huffman.write_ids(spark, table(spark, sf_dir, "documents"), WORD_BPE, folder)
    return huffman.digests(spark, folder)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a user's key comes with the session; without one the query takes a public key, so only its form counts
    key = spark.conf.get("pricetide.pii.key", None) or "public key of the query"
    return pii.replace(spark, table(spark, sf_dir, "documents"), key=key)


def op8_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, table(spark, sf_dir, "documents"))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_maxscore_topk": op3_maxscore_topk,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_huffman_ids": op5_huffman_ids,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_hnsw_near_dedup": op8_hnsw_near_dedup,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_secret_crf": op10_secret_crf,
    "op11_compression_quality": op11_compression_quality,
    "op12_target_resampling": op12_target_resampling,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE: dict[str, str] = {
    "op2_source_mixing": mixing.oracle_sql(),
    "op3_maxscore_topk": topk.oracle_sql(),
    "op6_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op8_hnsw_near_dedup": hnsw.oracle_sql(),
    "op12_target_resampling": resample.oracle_sql(),
    "op13_phrase_collocations": phrases.oracle_sql(),
}
