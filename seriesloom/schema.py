"""Column contracts of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CLEAN = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("total", T.DoubleType()),
    ]
)

POINT = T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType())])

METRIC = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("smape", T.DoubleType()),
    ]
)

FORECAST_STORE = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("fit_end", T.DateType()),
        T.StructField("best_model", T.StringType()),
        T.StructField("metrics", T.ArrayType(METRIC)),
        T.StructField("forecast", T.ArrayType(POINT)),
        T.StructField("all_forecasts", T.MapType(T.StringType(), T.ArrayType(POINT))),
        T.StructField("validation", T.ArrayType(POINT)),
    ]
)

PREDICTION_COLUMNS = ["state", "model", "phase", "step", "date", "yhat", "y"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Fail before any job starts when a column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; found {df.columns}")
    return df
