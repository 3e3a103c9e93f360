"""The forecast store: a Parquet table of records, appended run by run, and a JSON export."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.schema import FORECAST_STORE

PATH_VARIABLE = "FORECASTS_PATH"


def store_path(default: str) -> str:
    """The path of the store; the environment may name another one."""
    return os.environ.get(PATH_VARIABLE) or default


RUN_AT = T.StructField("run_at", T.TimestampType())


def write_records(records: DataFrame, path: str) -> None:
    """Append finished records with the time of the run. Each run adds files, so a broken run loses only its own states."""
    stamped = records.select(*FORECAST_STORE.fieldNames()).withColumn(RUN_AT.name, F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The newest record per state: by last month, then by the time of the run."""
    stored = spark.read.schema(T.StructType([*FORECAST_STORE.fields, RUN_AT])).parquet(store_path(path))
    record = F.struct(*FORECAST_STORE.fieldNames()).alias("r")
    newest = stored.groupBy("state").agg(F.max_by(record, F.struct("fit_end", RUN_AT.name)).alias("r"))
    return newest.select("r.*")


def export_json(records: DataFrame, path: str) -> None:
    """One JSON object per state and line, dates as ISO text."""
    records.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECAST_STORE).json(store_path(path))


def write_coefficients(fits: DataFrame, path: str) -> None:
    """Fitted per-series models are tables; trees and regressions save through their own writers."""
    fits.write.mode("overwrite").parquet(path)
