"""The competition in steps, each committed on its own, so that a broken job goes on where it stopped.

Series are dealt into groups by a hash of their name. A group's records are written to a folder of their own; when
they are complete, one entry with the folder's files and its number of records is added to the manifest. Readers go by
the manifest alone: files that it does not list, left behind by a job that was killed, are never read. An entry also has
the last month of every series' data as a checksum, so new data makes the group due again and its newest entry wins.

The manifest is a Parquet table with one row per committed group; its own files appear whole, because Spark moves them
into place when the write is committed. Two jobs may not step through one store at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.competition import compete, targets_of
from seriesloom.schema import FORECAST_STORE
from seriesloom.session import materialize

MANIFEST = "group int, groups int, data string, folder string, files array<string>, records long, at timestamp"
#: Groups that series are dealt into when the caller names no number.
GROUPS = 8


def group_of(groups: int):
    return F.pmod(F.xxhash64("state"), F.lit(groups)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the store; none if it does not exist yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def _newest(spark: SparkSession, path: str, groups: int | None = None) -> dict[int, object]:
    """The entries that count, by group: those of the newest number of groups, the newest of each group."""
    rows = sorted(manifest(spark, path).collect(), key=lambda r: r.at)
    wanted = groups if groups is not None else (rows[-1].groups if rows else None)
    return {r.group: r for r in rows if r.groups == wanted}


def data_states(panel: DataFrame, groups: int) -> dict[int, str]:
    """What each group's data ends with, as a text that changes when a series is added or grows."""
    ends = targets_of(panel).withColumn("group", group_of(groups))
    sums = ends.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("state", "fit_end").cast("decimal(38,0)")).alias("h"))
    return {r.group: f"{r.n}-{r.h}" for r in sums.collect()}


def due_groups(panel: DataFrame, path: str, groups: int = GROUPS) -> list[int]:
    """Groups without an entry for the panel's data."""
    done = _newest(panel.sparkSession, path, groups)
    return sorted(g for g, data in data_states(panel, groups).items() if g not in done or done[g].data != data)


def commit(records: DataFrame, path: str, group: int, groups: int, data: str) -> None:
    """Write the records of a group, then its manifest entry."""
    spark = records.sparkSession
    folder = f"data/group={group}-{uuid.uuid4().hex}"
    records.select(*FORECAST_STORE.fieldNames()).write.parquet(f"{path}/{folder}")
    written = spark.read.schema(FORECAST_STORE).parquet(f"{path}/{folder}")
    files = sorted(name.rsplit("/", 1)[-1] for name in written.inputFiles())
    entry = spark.createDataFrame([(group, groups, data, folder, files, written.count(), None)], MANIFEST)
    entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def compete_in_steps(
    panel: DataFrame, path: str, groups: int = GROUPS, after: Callable[[int], None] | None = None, **options
) -> list[int]:
    """Run the competition on every group that is due and commit it; returns the groups that were run.

    ``options`` are those of ``compete``; ``after`` is called with each group once it is committed. With another number of groups
    than before, all of them are due, and readers see the new ones as they come.
    """
    panel = materialize(panel.select("state", "date", "total"))
    states = data_states(panel, groups)
    due = due_groups(panel, path, groups)
    for group in due:
        outcome = compete(panel.filter(group_of(groups) == group), **options)
        commit(outcome.records, path, group, groups, states[group])
        if after:
            after(group)
    return due


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The records that the manifest lists, and no other file of the store."""
    entries = [r for r in _newest(spark, path).values() if r.files]
    files = [f"{path}/{r.folder}/{name}" for r in entries for name in r.files]
    if not files:
        return spark.createDataFrame([], FORECAST_STORE)
    return spark.read.schema(FORECAST_STORE).parquet(*files)
