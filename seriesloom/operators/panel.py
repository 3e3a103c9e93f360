"""The dense monthly panel: month sums, calendar grid, gap filling, split.

A series never has more rows here than the calendar has months, however many observations
stand behind it: ``monthly_sum`` is combined map-side first. That bound is what makes the
windows per series below safe for hot series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions.calendar import months_after
from seriesloom.functions.sums import exact_sum
from seriesloom.schema import require_columns

IN_TIME = "partition by state order by date"
MONTHS_SINCE = "(year({0}) * 12 + month({0}) - year({1}) * 12 - month({1}))"
MIN_PERIODS = 12
VALIDATION_PERIODS = 6


def by_series():
    return W.partitionBy("state")


def in_time():
    return W.partitionBy("state").orderBy("date")


def monthly_sum(clean: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Sum per state and month end. A month of only missing totals is 0 unless ``keep_missing``."""
    require_columns(clean, ["state", "date", "total"])
    sums = (
        clean.filter(F.col("state").isNotNull() & F.col("date").isNotNull())
        .groupBy("state", F.last_day("date").alias("date"))
        .agg(exact_sum("total").alias("total"))
    )
    return sums if keep_missing else sums.withColumn("total", F.coalesce("total", F.lit(0.0)))


def calendar_bounds(monthly: DataFrame) -> DataFrame:
    """First and last month over all series, one row.

    The extremes are taken over (date, total) so that this query reads the same columns as
    the panel itself: Spark then reuses the panel's shuffle and scans the source once.
    """
    pair = F.struct("date", "total")
    return monthly.agg(F.min(pair)["date"].alias("lo"), F.max(pair)["date"].alias("hi"))


def spread(monthly: DataFrame) -> DataFrame:
    """Shuffle by series into the session's full number of shuffle partitions.

    This is the shuffle the windows need anyway. Rows multiply behind it (filled gaps, phases,
    model columns), so it must not be merged into few partitions by the size it has here.
    """
    partitions = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return monthly.repartition(partitions, "state")


def _with_gaps(monthly: DataFrame, bounds: DataFrame | None, max_months: int | None = None, placed: bool = False) -> DataFrame:
    """Each present month followed by one row per missing month up to the next present one.

    The first month of a series also yields the months before it, the last one those after it.
    This builds the dense grid from one window per series, without a cross product or a join.

    With ``max_months``, a longer range stops the job: one stray year multiplies the rows of every
    series. ``panel_summary`` and ``quality_report`` show the range. ``placed`` rows are partitioned by series already,
    as those of a bucketed table are, and are not shuffled.
    """
    bounds = calendar_bounds(monthly) if bounds is None else bounds
    present = monthly.filter("total is not null")
    known = (present if placed else spread(present)).selectExpr(
        "state",
        "date",
        "total",
        f"lead(date) over ({IN_TIME}) as next_date",
        f"lead(total) over ({IN_TIME}) as next_total",
        f"row_number() over ({IN_TIME}) = 1 as leading",
    )
    known = known.withColumns({"lo": bounds.select("lo").scalar(), "hi": bounds.select("hi").scalar()})
    if max_months is not None:
        too_long = f"'the calendar has more than {max_months} months; set min_date and max_date'"
        width = MONTHS_SINCE.format("hi", "lo")
        known = known.withColumn("hi", F.expr(f"if({width} >= {max_months}, raise_error({too_long}), hi)"))
    grid = known.selectExpr(
        "*",
        """explode(sequence(trunc(if(leading, lo, date), 'month'),
                            trunc(coalesce(add_months(trunc(next_date, 'month'), -1), hi), 'month'),
                            interval 1 month)) as month""",
    )
    return grid.selectExpr(
        "state",
        "last_day(month) as date",
        f"{MONTHS_SINCE.format('month', 'date')} = 0 as observed",
        f"{MONTHS_SINCE.format('month', 'date')} as ahead",
        f"{MONTHS_SINCE.format('next_date', 'date')} as width",
        "total as known_total",
        "next_total",
    )


def dense_grid(monthly: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """All states by all months of the common range; absent months carry a NULL total."""
    return _with_gaps(monthly, bounds).select(
        "state", "date", F.expr("if(observed, known_total, null)").alias("total")
    )


def forward_fill(df: DataFrame, value: str = "total") -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(in_time()))


def back_fill(df: DataFrame, value: str = "total") -> DataFrame:
    backwards = by_series().orderBy(F.desc("date"))
    return df.withColumn(value, F.last(value, ignorenulls=True).over(backwards))


def interpolate_linear(df: DataFrame, value: str = "total") -> DataFrame:
    """Fill inner gaps on the line between their neighbours, by row position.

    A trailing gap repeats the last value; a leading gap stays missing.
    """
    position = F.row_number().over(in_time())
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("at"), F.col(value).alias("v")))
    placed = df.withColumn("at", position)
    placed = placed.withColumns(
        {
            "before": F.last(here, ignorenulls=True).over(in_time()),
            "after": F.last(here, ignorenulls=True).over(by_series().orderBy(F.desc("date"))),
        }
    )
    slope = (F.col("after.v") - F.col("before.v")) * (F.col("at") - F.col("before.at"))
    inner = F.col("before.v") + slope / (F.col("after.at") - F.col("before.at"))
    gap = F.col(value).isNull() & F.col("before").isNotNull() & F.col("after").isNotNull()
    filled = F.when(gap, inner).otherwise(F.coalesce(F.col(value), F.col("before.v")))
    return placed.withColumn(value, filled).select(*df.columns)


def enough_periods(df: DataFrame, at_least: int = MIN_PERIODS, counted: Column | None = None) -> DataFrame:
    """Rows of the series with ``at_least`` counted rows; shares the panel's partitioning."""
    counted = F.col("total").isNotNull() if counted is None else counted
    size = F.count(F.when(counted, 1)).over(by_series())
    return df.withColumn("_size", size).filter(F.col("_size") >= at_least).drop("_size")


def dropped_series(df: DataFrame, at_least: int = MIN_PERIODS, counted: Column | None = None) -> DataFrame:
    """The states that ``enough_periods`` leaves out."""
    counted = F.col("total").isNotNull() if counted is None else counted
    sizes = df.groupBy("state").agg(F.count_if(counted).alias("n"))
    return sizes.filter(F.col("n") < at_least).select("state")


def build_monthly_panel(
    clean: DataFrame,
    min_periods: int = MIN_PERIODS,
    min_observed: int = 0,
    impute_invalid: bool = False,
    min_date: str | None = None,
    max_date: str | None = None,
    max_months: int | None = None,
) -> DataFrame:
    """Dense panel ``(state, date, total, observed)``, unique per (state, date), no gaps.

    ``impute_invalid`` treats a month of only missing totals as a gap instead of 0;
    ``min_observed`` counts months with data, while ``min_periods`` counts filled rows.
    """
    rows = clean
    if min_date:
        rows = rows.filter(F.col("date") >= F.lit(min_date).cast("date"))
    if max_date:
        rows = rows.filter(F.col("date") <= F.lit(max_date).cast("date"))
    sums = monthly_sum(rows, keep_missing=True)
    return panel_of_sums(sums, min_periods, min_observed, impute_invalid, max_months)


def panel_of_sums(
    sums: DataFrame,
    min_periods: int = MIN_PERIODS,
    min_observed: int = 0,
    impute_invalid: bool = False,
    max_months: int | None = None,
    bounds: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """The dense panel of month sums ``(state, date, total)`` in which a month of only missing totals is NULL."""
    known = sums if impute_invalid else sums.withColumn("total", F.coalesce("total", F.lit(0.0)))
    grid = _with_gaps(known, calendar_bounds(sums) if bounds is None else bounds, max_months, placed)
    total = """if(ahead > 0 and width is not null,
                  known_total + (next_total - known_total) * ahead / width, known_total) as total"""
    panel = grid.selectExpr("state", "date", total, "observed")
    panel = enough_periods(panel, min_periods)
    if min_observed:
        panel = enough_periods(panel, min_observed, F.col("observed"))
    return panel


def train_val_split(panel: DataFrame, val_periods: int = VALIDATION_PERIODS) -> DataFrame:
    """Mark the last ``val_periods`` rows of each series ``val``, the others ``train``."""
    size = F.count(F.lit(1)).over(by_series())
    marked = panel.withColumns({"_at": F.row_number().over(in_time()), "_size": size})
    split = F.when(F.col("_at") > F.col("_size") - val_periods, "val").otherwise("train")
    return marked.withColumn("split", split).drop("_at", "_size")


def part(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).drop("split")


def split_report(split: DataFrame) -> DataFrame:
    train, val = F.col("split") == "train", F.col("split") == "val"
    return split.groupBy("state").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(val).alias("n_val"),
        F.max(F.when(train, F.col("date"))).alias("last_train"),
        F.min(F.when(val, F.col("date"))).alias("first_val"),
    )


def split_overlap(split: DataFrame) -> DataFrame:
    """Number of (state, date) pairs on both sides of the split; one pass, no set operation."""
    sides = split.groupBy("state", "date").agg((F.min("split") != F.max("split")).alias("both"))
    return sides.agg(F.count_if("both").alias("n_overlap"))


def trainable(split: DataFrame, min_train: int = 15) -> DataFrame:
    """Rows of the series with at least ``min_train`` training rows."""
    return enough_periods(split, min_train, F.col("split") == "train")


def series_of(panel: DataFrame, state: str) -> DataFrame:
    """One series at month-end frequency: months without a row appear with a NULL total."""
    rows = panel.filter(F.col("state") == state).select("state", "date", "total")
    return dense_grid(rows)


def last_rows(panel: DataFrame, k: int) -> DataFrame:
    newest = F.row_number().over(by_series().orderBy(F.desc("date")))
    return panel.withColumn("_newest", newest).filter(F.col("_newest") <= k).drop("_newest")


def tail_split(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """Mark the newest share (at least one row) of each series as the inner hold-out."""
    size = F.count(F.lit(1)).over(by_series())
    held = F.greatest(F.lit(1), F.floor(size * F.lit(share)).cast("int"))
    late = F.row_number().over(in_time()) > size - held
    return rows.withColumn("part", F.when(late, "val").otherwise("train"))


def infer_frequency(panel: DataFrame, default: str = "ME") -> DataFrame:
    """``ME`` or ``MS`` per series whose dates are consecutive month ends or starts, else the default."""
    previous = panel.selectExpr("state", "date", f"lag(date) over ({IN_TIME}) as previous")
    checked = previous.selectExpr(
        "state",
        f"coalesce({MONTHS_SINCE.format('date', 'previous')} = 1, true) as consecutive",
        "date = last_day(date) as at_end",
        "day(date) = 1 as at_start",
    )
    facts = checked.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and("consecutive").alias("monthly"),
        F.bool_and("at_end").alias("ends"),
        F.bool_and("at_start").alias("starts"),
    )
    regular = (F.col("n") >= 3) & F.col("monthly")
    freq = F.when(regular & F.col("ends"), "ME").when(regular & F.col("starts"), "MS").otherwise(default)
    return facts.select("state", freq.alias("freq"))


def future_calendar(panel: DataFrame, horizon: int = 2) -> DataFrame:
    """The next ``horizon`` month ends of each series."""
    last = panel.groupBy("state").agg(F.max("date").alias("last_date"))
    steps = last.select("state", "last_date", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select("state", "step", months_after("last_date", "step").alias("date"))
