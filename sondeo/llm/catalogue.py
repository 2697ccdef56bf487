"""The operators as named queries over the test tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import alignment, ann, bpe, jaccard, langid, licenses, lm, merkle, neardup, packing, quality, secret_scan, toxicity
from sondeo.llm.support import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trained_on(docs: DataFrame) -> DataFrame:
    """Rows that may teach: the remainder of their key is not 0."""
    return docs.filter(fold(F.col("doc_id")) != 0)


def held_out() -> F.Column:
    return (fold(F.col("doc_id")) == 0).alias("held_out")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(trained_on(docs)))
    return found.select("doc_id", held_out(), "lang_pred", "score")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(trained_on(docs), table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(), "score", "predicted")


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(trained_on(docs), table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=merkle.tampered_rows(), changed={"text": merkle.lowered(F.col("text"))})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 1)
    return found.select("doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (
    op1_nn_descent, op2_language_id, op3_bpe_round_trip, op4_secret_scan, op5_quality, op6_cross_polytope, op7_license_scan,
    op8_jaccard_join, op9_toxicity, op10_best_fit_packing, op11_merkle_manifest, op12_token_alignment, op13_lm_score)}
SQL = {"op7_license_scan": licenses.scan_sql(), "op11_merkle_manifest": merkle.manifest_sql()}
