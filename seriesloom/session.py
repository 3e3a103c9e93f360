"""Session helpers: a local session for tests and benchmarks, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app_name: str = "seriesloom", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that left it unset
    gets a fresh temporary folder; a cluster session without the setting is refused, because
    a folder of one machine would be lost with that machine.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a working table below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage; the result keeps its partitioning."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def side_by_side(jobs: list[Callable]) -> list:
    """Results of independent Spark jobs submitted from threads, in order."""
    if len(jobs) == 1:
        return [jobs[0]()]
    session = SparkSession.getActiveSession()
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: inheritable_thread_target(session)(job)() if session else job(), jobs)
