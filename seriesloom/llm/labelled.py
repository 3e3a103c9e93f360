"""A bounded, repeatable sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a fit reads; the rows with the smallest hash of their id are taken.
SAMPLE_ROWS = 20_000


def training_sample(labels: DataFrame, label_col: str, allowed: Column, bound: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``bound`` rows (doc_id, label) that ``allowed`` admits, small enough to broadcast by their bound.

    Rows with a NULL id, label or ``allowed`` are left out; repeated ids count once, with their
    smallest label.
    """
    spark = labels.sparkSession
    kind = labels.schema["doc_id"].dataType.simpleString()
    chosen = (
        labels.filter(allowed & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(F.col(label_col)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
        .collect()
    )
    return spark.createDataFrame([tuple(r) for r in chosen], f"doc_id {kind}, label int")


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of the sampled rows; the sample is broadcast, its size is bounded."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.join(F.broadcast(sample), "doc_id")
