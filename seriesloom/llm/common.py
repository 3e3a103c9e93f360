"""Helpers that the operators share: reading, Arrow mapping, training splits, lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesloom.session import materialize

__all__ = ["add_columns", "checkpointed", "crc_remainder", "in_arrow", "map_texts", "read_table", "slices", "texts_of", "workers_import"]

#: Bytes of text that a task turns into numpy arrays at once; one longer text is taken alone.
SLICE_BYTES = 4 << 20


def workers_import(spark: SparkSession) -> None:
    """Send this library to the Python workers, once per application, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_library_sent", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._library_sent = True


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with the library at hand in the workers; every Arrow map of the operators goes through here."""
    workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string")) % modulus


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, so lost executors lose nothing."""
    return materialize(df)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Values of a string column, with '' for NULL."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array whose texts hold about ``limit`` bytes; every row is in one range."""
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - 1).clip(0) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def add_columns(docs: DataFrame, schema: str, rows: Callable[[list[str]], list], text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``schema``, which ``rows`` makes from whole texts (one list per column).

    A NULL text counts as ''. The new names must not be in ``docs``.
    """
    at = docs.columns.index(text_col)
    added = StructType.fromDDL(schema)
    types, names = to_arrow_schema(added).types, [*docs.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                made = rows(texts_of(part.column(at)))
                arrays = [pa.array(c, type=t) for c, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names)

    return in_arrow(docs, run, StructType([*docs.schema.fields, *added.fields]))


def map_texts(
    docs: DataFrame,
    schema: str,
    rows: Callable[[list[str]], list],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id column and the columns that ``rows`` makes from whole texts (see ``add_columns``).

    The id keeps its type and name, NULL ids stay. Only the two named columns are read, so other
    columns cannot clash with the result's.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return add_columns(narrow, schema, rows, "_text").drop("_text").withColumnRenamed("_id", id_col)
