"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.llm import imatch, knn, langid, lexical, licences, mixing, packing, quality, sharding, simhash, spelling, sql, tokens, warc
from corpusward.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their sources; every eighth is the licence file of a directory."""
    docs, number = table(spark, sf_dir, "documents"), F.col("doc_id")
    is_licence = number % 8 == 3
    name = F.when(is_licence, F.format_string("LICENSE-%d", number)).otherwise(F.format_string("%d/%d.txt", F.floor(number / 100) % 10, number))
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.floor(number / 1000).cast("string"), F.lit("/"), name)
    files = docs.select("doc_id", F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"))
    return licences.scan(files).select("row.doc_id", "row.path", "own_licence", "own_score", "licence", "given_by")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_imatch_fingerprints": op2_imatch_fingerprints,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_warc_archive": op7_warc_archive,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_licence_scan": op9_licence_scan,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = dict(sql.ORACLES)
