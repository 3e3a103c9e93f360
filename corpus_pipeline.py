"""A training-data pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of ``documents``; the last gives the place of every piece of
every document in packed sequences. Stages are written as Parquet and read again, so a stage that fails is
repeated from its predecessor's files.

Documents with a NULL id or text go through like others: empty texts are scored as empty, rows with a
NULL id have no duplicates. Repeated rows count as copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import fast_minhash, gam, packing, secret_scan, toxicity
from seriesloom.llm.common import crc_remainder, read_table
from seriesloom.llm.queries import RANKS, WORDS
from seriesloom.session import scratch_path

#: Least quality score that is kept, and least toxicity score that is rejected.
QUALITY, TOXICITY = 0.3, 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``QUALITY``; the model is fitted on labelled ones among them."""
    model = gam.train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return gam.score(docs, model, keep="_score").filter(F.col("_score") >= QUALITY).drop("_score")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXICITY``."""
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    return toxicity.score(docs, lexicon, keep="_score").filter(F.col("_score") < TOXICITY).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    found = fast_minhash.near_duplicates(docs)
    kept = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(docs.columns).union(docs.filter("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced by the names of their kinds; n_chars follows the text."""
    clean = secret_scan.mask_secrets(docs, RANKS, public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of the permitted lengths, measured in words."""
    return packing.pack_documents(docs, F.regexp_count("text", F.lit(WORDS)))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packed),
]

#: The classifiers and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all rows of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
