"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.llm import alignment, bpe, caps, decontamination, hnsw, mixing, native_sql, placement, scoring, simhash, substrings, toxicity, urls, whitening
from tablekin.llm.common import table

#: Times that mixing may use a source's tokens.
REPEATS = 1.25


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")


def cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return scoring.losses(table(spark, sf_dir, "documents"), good)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.Target(repeats=REPEATS, budget=1.0)).select("doc_id", "source", "copies")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return placement.place(docs.select("doc_id"), "doc_id", placement.names(placement.SHARDS))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment(table(spark, sf_dir, "documents"), *files)


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash_near_dedup,
    "op2_decontamination": benchmark_overlaps,
    "op3_substrings": repeated_passages,
    "op4_url_filter": url_verdicts,
    "op5_lm_scoring": cross_entropy_difference,
    "op6_mixing": temperature_mixing,
    "op7_hnsw": nearest_neighbours,
    "op8_token_counts": token_counts,
    "op9_sharding": sharding,
    "op10_toxicity": toxicity_scores,
    "op11_alignment": tokenizer_alignment,
    "op12_whitening": whitened_embeddings,
    "op13_spherical_caps": embedding_near_duplicates,
}
SQL: dict[str, str] = {
    "op2_decontamination": native_sql.decontamination(decontamination.WINDOW, decontamination.MISSES, 6),
    "op4_url_filter": native_sql.url_verdicts(urls.RULES, urls.Tree()),
    "op6_mixing": native_sql.mixing(REPEATS, mixing.BLOCK, mixing.GRID),
    "op9_sharding": native_sql.sharding(placement.SHARDS, placement.SLOTS),
}
