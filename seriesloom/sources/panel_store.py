"""The stored panel: month sums in a table that is bucketed by series and partitioned by month.

A series lies in one bucket of every month, so windows and aggregates per series read the table without a shuffle, and a
query of one series reads one bucket. Sums are kept as their exact parts, so observations that arrive later, in new
months or in known ones, are added by rewriting the months they touch; the result equals that of summing all
observations anew. Gaps are filled when the panel is read, because one new month moves the end of every series.

The table lives in the session's catalog, its files in the warehouse or below ``path``, which executors must reach. A
merge first computes the new rows of the months it touches into reliable storage and then replaces these months;
merges of one table must not run at the same time. Rows without a state or date belong to no month and are left out, as in ``monthly_sum``.

"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.sums import CUTS, exact_part_sqls, joined_parts
from seriesloom.operators.panel import panel_of_sums
from seriesloom.schema import require_columns
from seriesloom.session import materialize

PARTS = [f"part_{i}" for i in range(len(CUTS))]
#: Buckets of a new table when the caller names none.
BUCKETS = 32
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def month_parts(clean: DataFrame) -> DataFrame:
    """``(state, part_0 .., n, date)`` per state and month end: the exact parts of the sum and the number of rows."""
    require_columns(clean, ["state", "date", "total"])
    known = clean.filter(F.col("state").isNotNull() & F.col("date").isNotNull())
    parts = [F.expr(sql).alias(name) for name, sql in zip(PARTS, exact_part_sqls("total"), strict=True)]
    sums = known.groupBy("state", F.last_day("date").alias("date")).agg(*parts, F.count(F.lit(1)).alias("n"))
    return sums.select("state", *PARTS, "n", "date")


def create_store(clean: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Write the month sums of all observations; the table must not exist."""
    writer = month_parts(clean).repartition(buckets, "state").write.format("parquet").partitionBy("date")
    writer = writer.bucketBy(buckets, "state").sortBy("state")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def merge_observations(new: DataFrame, table: str) -> list[datetime.date]:
    """Add observations to the store and return the months that were rewritten."""
    spark = new.sparkSession
    added = materialize(month_parts(new))
    months = sorted(r.date for r in added.select("date").distinct().collect())
    if not months:
        return months
    old = spark.table(table).filter(F.col("date").isin(months)).select(*added.columns)
    sums = [F.sum(name).alias(name) for name in [*PARTS, "n"]]
    merged = materialize(old.unionByName(added).groupBy("state", "date").agg(*sums).select(*added.columns))
    buckets = bucket_count(spark, table)
    # the session's mode decides whether other months stay: the writer's option of this name does not reach insertInto
    before = spark.conf.get(OVERWRITE, None)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        merged.repartition(buckets, "state").write.insertInto(table, overwrite=True)
    finally:
        if before is None:
            spark.conf.unset(OVERWRITE)
        else:
            spark.conf.set(OVERWRITE, before)
    return months


def bucket_count(spark: SparkSession, table: str) -> int:
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return int(described["Num Buckets"])


def stored_months(spark: SparkSession, table: str) -> list[datetime.date]:
    """The months of the store, from its partitions; no file is read."""
    names = (r.partition.split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    return sorted(datetime.date.fromisoformat(name) for name in names)


def stored_sums(spark: SparkSession, table: str) -> DataFrame:
    """``(state, date, total)`` of the store; NULL for a month of only missing totals."""
    return spark.table(table).select("state", "date", F.expr(joined_parts(PARTS)).alias("total"))


def stored_panel(spark: SparkSession, table: str, **rules) -> DataFrame:
    """The dense panel out of the store, without a shuffle; ``rules`` are those of ``panel_of_sums``."""
    months = stored_months(spark, table)
    ends = [(months[0], months[-1])] if months else [(None, None)]
    bounds = spark.createDataFrame(ends, "lo date, hi date")
    return panel_of_sums(stored_sums(spark, table), bounds=bounds, placed=True, **rules)
