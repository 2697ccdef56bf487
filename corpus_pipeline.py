"""A corpus pipeline of five stages, each applied to all that the one before kept.

Language identification drops documents without a language, the quality classifier those it rejects, the
Jaccard join all but one of each group of near copies, the secret scan blots out secrets, and packing lays the
rest out in training sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import jaccard, langid, packing, quality, secret_scan
from sondeo.llm.catalogue import trained_on
from sondeo.llm.support import Shipped, bitmap, in_bitmap, stored

#: No stage but the last could be left out of SQL, and classifiers, tokens and packing cannot be said in it.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones of the input show; text without any letter goes, and text whose
    n-grams speak for none of these languages."""
    filters = langid.learn(trained_on(docs))
    return _kept(docs, lambda plain, text: langid.identify(plain, filters, text=text, keep=plain.columns, shown="shown").filter("shown"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labelled documents of the input, does not reject."""
    model = quality.learn(trained_on(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda plain, text: quality.score(plain, model, text=text, keep=plain.columns).filter("predicted = 1"))


def _kept(docs: DataFrame, judged) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (of the rows and the name of their text) keeps, whatever names their columns have."""
    plain = docs.toDF(*[f"in{i}" for i in range(len(docs.columns))])
    left = judged(plain, f"in{docs.columns.index('text')}")
    return left.select(*plain.columns).toDF(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, one of them where rows are repeated.

    Rows are told apart by a number of their own, so a repeated or null id neither takes another text along nor saves a
    copy. Only rows that a bitmap takes for copies are joined with their list: the others' texts are not moved.
    """
    names = [f"in{i}" for i in range(len(docs.columns))]
    plain = stored(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = jaccard.jaccard_components(plain, key="row", text=text)
    ids = plain.select("row", F.struct(F.col(key).isNull(), F.col(key), F.col("row")).alias("place"))
    members = stored(found.select("row", "component_id").join(ids, "row"))
    stays = members.groupBy("component_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(members.join(stays, "component_id").filter("row <> first.row").select(F.col("row").alias("copy")))
    shipped = Shipped(spark, bitmap(copies, "copy"))      # a megabyte

    @F.pandas_udf("boolean")
    def may_be_copy(rows: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shipped.value, rows.to_numpy(dtype="int64")))

    marked = plain.withColumn("maybe", may_be_copy("row"))
    rest = marked.filter("maybe").join(copies, F.col("row") == F.col("copy"), "left_anti")
    return marked.filter("not maybe").select(*names).unionByName(rest.select(*names)).toDF(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets and ``n_chars`` counted anew where it was given."""
    clean = secret_scan.redact(docs, [c for c in docs.columns if c != "text"])
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        clean = clean.withColumn("n_chars", counted)
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
