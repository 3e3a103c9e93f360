"""From raw text rows to one typed observation per (state, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seriesloom.functions.parsing import normalized_name, parse_date, parse_money
from seriesloom.schema import require_columns


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalized_name(name) for name in df.columns])


def parse_observations(raw: DataFrame) -> DataFrame:
    """Typed ``date`` and ``total``; every other column and every row is kept."""
    require_columns(raw, ["state", "date", "total"])
    return raw.withColumns({"date": parse_date(F.col("date")), "total": parse_money(F.col("total"))})


def dedupe_first(df: DataFrame, keys: list[str] | None = None, order: str = "rid") -> DataFrame:
    """The first row of each key by ``order``; a missing value wins if it came first.

    An aggregate rather than a ranking window: each task reduces its rows before the shuffle,
    so a key that holds a large share of the table sends one row per task.
    """
    keys = keys or ["state", "date"]
    values = [name for name in df.columns if name not in (*keys, order)]
    if len(values) == 1:
        kept = df.groupBy(*keys).agg(F.min_by(values[0], order).alias(values[0]))
        return kept.select(*keys, *values)
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("kept"))
    return kept.select(*keys, *[F.col("kept")[name].alias(name) for name in values])


def clean_observations(raw: DataFrame, order: str = "rid") -> DataFrame:
    """Normalise names, parse, drop rows without a date, keep the first row per (state, date)."""
    named = normalize_columns(raw)
    typed = parse_observations(named).filter(F.col("date").isNotNull())
    return dedupe_first(typed, order=order)


def quality_report(raw: DataFrame) -> DataFrame:
    """One row of counts: unparsed dates, unparsed totals, duplicates, final rows, range.

    Counted in three widening steps, (state, date), then state, then all, so distinct
    counts need no expansion and every step is combined map-side.
    """
    dated = F.col("date").isNotNull()
    days = (
        parse_observations(raw)
        .groupBy("state", "date")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total").isNull()).alias("bad"))
    )
    states = days.groupBy("state").agg(
        F.sum("n").alias("n_rows_raw"),
        F.sum(F.when(~dated, F.col("n")).otherwise(0)).alias("n_bad_dates"),
        F.sum(F.when(dated, F.col("bad")).otherwise(0)).alias("n_bad_totals"),
        F.sum(F.when(dated, F.col("n") - 1).otherwise(0)).alias("n_duplicates"),
        F.count_if(dated).alias("n_rows_clean"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
    sums = ["n_rows_raw", "n_bad_dates", "n_bad_totals", "n_duplicates", "n_rows_clean"]
    return states.agg(
        *[F.sum(name).alias(name) for name in sums],
        F.count_if(F.col("state").isNotNull() & F.col("min_date").isNotNull()).alias("n_states"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
    )


def observed_counts(raw: DataFrame) -> tuple[DataFrame, Observation, Observation]:
    """The cleaned rows and two observations that fill while these are written.

    The first counts rows, bad dates and bad totals before the deduplication, the second cleaned rows and the range of dates.
    """
    before, after = Observation(), Observation()
    dated = F.col("date").isNotNull()
    typed = parse_observations(normalize_columns(raw)).observe(
        before,
        F.count(F.lit(1)).alias("n_rows_raw"),
        F.count_if(~dated).alias("n_bad_dates"),
        F.count_if(dated & F.col("total").isNull()).alias("n_bad_totals"),
    )
    clean = dedupe_first(typed.filter(dated), order="rid").observe(
        after, F.count(F.lit(1)).alias("n_rows_clean"), F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )
    return clean, before, after


def write_clean(raw: DataFrame, path: str) -> dict[str, object]:
    """Write the cleaned rows of ``(rid, state, date, total)`` to ``path`` and return the counts of the same pass.

    Observations of a job are exact when no stage of it runs twice; after a lost executor, repeated tasks may count
    twice, so a job that was repaired should take ``quality_report`` instead.
    """
    clean, before, after = observed_counts(raw)
    clean.write.mode("overwrite").parquet(path)
    found = before.get | after.get
    return found | {"n_duplicates": found["n_rows_raw"] - found["n_bad_dates"] - found["n_rows_clean"]}


def counts_with_range(counts: dict[str, object], clean: DataFrame) -> DataFrame:
    """The observed counts as one row, with the number of states of the cleaned rows."""
    kinds = {name: "date" if name.endswith("date") else "long" for name in counts}
    known = [F.lit(value).cast(kinds[name]).alias(name) for name, value in counts.items()]
    return clean.agg(F.countDistinct("state").alias("n_states")).select(*known, "n_states")
