"""The stored panel against a rebuild from all observations."""

import datetime
import re
import uuid

import pytest
from months import month_ends
from pyspark.sql import functions as F

from seriesloom.models import baselines
from seriesloom.models.frame import phase_frame
from seriesloom.models.registry import BASELINES
from seriesloom.operators.panel import build_monthly_panel, monthly_sum, train_val_split
from seriesloom.plans import records as rec, serving
from seriesloom.sources import panel_store as store

D = datetime.date


@pytest.fixture
def table(spark, tmp_path):
    name = f"panel_{uuid.uuid4().hex}"
    yield name, str(tmp_path / "panel")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def observations(spark, months):
    rows = []
    for s in range(40):
        for i, end in enumerate(months):
            if (s * 7 + i) % 5:
                rows += [(f"s{s}", end.replace(day=d), (0.1 + s) * 10.0 ** ((i * d) % 9) if (i + d) % 11 else None) for d in (1, 9, 20)]
    rows += [(None, months[0], 1.0), ("s1", None, 1.0)]
    return spark.createDataFrame(rows, "state string, date date, total double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_more_month_equals_a_rebuild(spark, table):
    name, path = table
    months = month_ends(2019, 1, 30)
    store.create_store(observations(spark, months[:29]), name, buckets=4, path=path)
    assert store.merge_observations(observations(spark, months[29:]), name) == [months[29]]
    whole = observations(spark, months[:29]).union(observations(spark, months[29:]))
    assert rows_of(store.stored_sums(spark, name)) == rows_of(monthly_sum(whole, keep_missing=True))
    assert rows_of(store.stored_panel(spark, name)) == rows_of(build_monthly_panel(whole))
    assert store.stored_months(spark, name) == months


def test_late_rows_of_known_months_are_added_exactly(spark, table):
    """Any split of the observations gives the same sums to the last digit; other months are left alone."""
    name, path = table
    whole = observations(spark, month_ends(2019, 1, 15))
    early = F.coalesce(F.crc32(F.concat_ws("|", "state", "date").cast("binary")) % 3 > 0, F.lit(True))
    store.create_store(whole.filter(early), name, buckets=3, path=path)
    late = whole.filter(~early & (F.col("date") < D(2019, 9, 1)))
    before = spark.table(name).filter("date > '2019-09-01'").select(F.input_file_name()).distinct().collect()
    assert max(store.merge_observations(late, name)) == D(2019, 8, 31)
    assert rows_of(store.stored_sums(spark, name)) == rows_of(monthly_sum(whole.filter(early).union(late), keep_missing=True))
    assert sorted(before) == sorted(spark.table(name).filter("date > '2019-09-01'").select(F.input_file_name()).distinct().collect())
    assert store.merge_observations(late.limit(0), name) == []


def test_history_and_chart_read_the_store_without_a_shuffle(spark, table):
    name, path = table
    store.create_store(observations(spark, month_ends(2019, 1, 30)), name, buckets=8, path=path)
    panel = store.stored_panel(spark, name)
    records = spark.createDataFrame(
        rec.forecast_records(baselines.baseline_predictions(phase_frame(panel)), BASELINES).collect(),
        rec.forecast_records(baselines.baseline_predictions(phase_frame(panel)), BASELINES).schema,
    )
    recent = final_plan(serving.history_view(panel, records))
    chart = final_plan(rec.chart_frame(train_val_split(panel.drop("observed")), records))
    for plan in (recent, chart):
        scanned = set(re.findall(r"FileScan parquet [^\[]*\[state#(\d+)", plan))
        assert scanned and not scanned & set(re.findall(r"Exchange hashpartitioning\(state#(\d+)", plan))
    assert "Exchange" not in chart
    one = final_plan(serving.history_view(panel.filter("state = 's7'"), records.filter("state = 's7'")))
    assert "SelectedBucketsCount: 1 out of 8" in one and "SelectedBucketsCount: 8" not in one
    assert rows_of(panel.filter("state = 's7'")) == rows_of(build_monthly_panel(observations(spark, month_ends(2019, 1, 30))).filter("state = 's7'"))
