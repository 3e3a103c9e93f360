"""Delimited text with every column read as a string."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.parsing import missing_to_null

#: Rows of a partition in a row id of Spark, and the room for block offsets and rows in ``rid``.
POSITION = (1 << 33) - 1
ROWS = "10000000000BD"
BLOCKS = "10000000000000000000000000BD"

#: The start of a file's address, which is written with one or three slashes.
SLASHES = "^([a-zA-Z0-9+.-]+):/+"


def scan_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """All-string scan of CSV files; tokens that mean "missing" become NULL.

    ``rid`` gives rows the order they have in the files, whatever the split of files into
    tasks: rank of the file by path, then byte offset of the block, then position inside the block.
    It is one number of fixed width, so a deduplication by it is a hash aggregate. The ranks are a small
    table of the paths that the scan lists anyway.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns]))
    raw = reader.csv(path)
    cells = [missing_to_null(F.col(f"`{name}`")).alias(name) for name in raw.columns]
    position = F.monotonically_increasing_id().bitwiseAND(POSITION)
    placed = raw.select(
        *cells,
        F.regexp_replace("_metadata.file_path", SLASHES, "$1:/").alias("_path"),
        F.col("_metadata.file_block_start").cast("decimal(38,0)").alias("_block"),
        position.cast("decimal(38,0)").alias("_position"),
    )
    files = [(rank, re.sub(SLASHES, r"\1:/", path)) for rank, path in enumerate(sorted(raw.inputFiles()))]
    ranks = spark.createDataFrame(files, "_rank long, _path string")
    rank = "cast(coalesce(_rank, raise_error('a file that was not listed')) as decimal(38,0))"
    rid = F.expr(f"{rank} * {BLOCKS} + _block * {ROWS} + _position").cast("decimal(38,0)")
    return placed.join(ranks, "_path", "left").withColumn("rid", rid).drop("_path", "_rank", "_block", "_position")
