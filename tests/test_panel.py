import datetime

import numpy as np
import pandas as pd
import pytest
from months import month_ends
from pyspark.sql import functions as F

from seriesloom.operators import panel as panels

D = datetime.date


def frame(spark, rows):
    return spark.createDataFrame(rows, "state string, date date, total double")


def test_month_of_missing_totals_is_zero_unless_imputed(spark):
    rows = [("A", D(2020, 1, 5), 2.0), ("A", D(2020, 2, 5), None), ("A", D(2020, 3, 1), 4.0), ("A", D(2020, 3, 9), None)]
    clean = frame(spark, rows)
    default = panels.build_monthly_panel(clean, min_periods=1).orderBy("date").collect()
    assert [r.total for r in default] == [2.0, 0.0, 4.0]
    imputed = panels.build_monthly_panel(clean, min_periods=1, impute_invalid=True).orderBy("date").collect()
    assert [(r.total, r.observed) for r in imputed] == [(2.0, True), (3.0, False), (4.0, True)]


def test_gaps_follow_pandas(spark):
    """Random gaps in several series against pandas reindex and interpolate."""
    rng = np.random.default_rng(7)
    rows = []
    months = month_ends(2019, 3, 40)
    for s in range(6):
        for m in months:
            if rng.random() < 0.4:
                rows.append((f"S{s}", m, round(float(rng.uniform(1, 1000)), 2)))
    rows += [("edge", months[0], 1.0), ("edge2", months[-1], 2.0)]
    got = panels.build_monthly_panel(frame(spark, rows)).toPandas()
    pdf = pd.DataFrame(rows, columns=["state", "date", "total"])
    pdf["month"] = pd.to_datetime(pdf["date"]).dt.to_period("M")
    index = pd.MultiIndex.from_product(
        [pdf.state.unique(), pd.period_range(pdf.month.min(), pdf.month.max(), freq="M")], names=["state", "month"]
    )
    want = pdf.groupby(["state", "month"])["total"].sum().reindex(index).reset_index()
    want["total"] = want.groupby("state")["total"].transform(lambda s: s.interpolate(method="linear").ffill().bfill())
    got["month"] = pd.to_datetime(got["date"]).dt.to_period("M")
    both = want.merge(got, on=["state", "month"], suffixes=("_want", "_got"))
    assert len(both) == len(want) == len(got)
    np.testing.assert_allclose(both.total_got, both.total_want, rtol=1e-12)


def test_fill_operators(spark):
    values = [None, 1.0, None, 3.0, None, None]
    df = frame(spark, [("A", d, v) for d, v in zip(month_ends(2020, 1, 6), values)])

    def run(made):
        return [r.total for r in made.orderBy("date").collect()]

    assert run(panels.interpolate_linear(df)) == [None, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert run(panels.forward_fill(df)) == [None, 1.0, 1.0, 3.0, 3.0, 3.0]
    assert run(panels.back_fill(df)) == [1.0, 1.0, 3.0, 3.0, None, None]
    assert run(panels.back_fill(panels.forward_fill(panels.interpolate_linear(df)))) == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]


def test_dense_grid_has_every_state_and_month_once(spark):
    df = frame(spark, [("A", D(2020, 1, 31), 1.0), ("B", D(2020, 4, 30), 2.0), ("B", D(2020, 6, 30), 3.0)])
    grid = panels.dense_grid(df)
    assert grid.count() == 12 == grid.select("state", "date").distinct().count()
    assert grid.filter("total is not null").count() == 3


def test_panel_scans_its_source_once(spark, tmp_path):
    rows = [("A", D(2020, 1, 31), 1.0), ("B", D(2020, 4, 30), 2.0)]
    frame(spark, rows).write.parquet(str(tmp_path / "t"))
    panel = panels.build_monthly_panel(spark.read.parquet(str(tmp_path / "t")), min_periods=1)
    panel.collect()
    plan = panel._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in panel._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dates_increase_per_state(sample_panel):
    panel = panels.build_monthly_panel(sample_panel)
    steps = panel.selectExpr("date > lag(date) over (partition by state order by date) as later")
    assert steps.filter("not later").count() == 0 and panel.filter("total is null").count() == 0


def test_null_states_are_left_out_of_the_panel(spark):
    df = frame(spark, [(None, D(2020, 1, 31), 1.0), ("A", D(2020, 1, 31), 2.0)])
    assert [r.state for r in panels.monthly_sum(df).collect()] == ["A"]


def test_huge_totals_are_added_as_doubles(spark):
    df = frame(spark, [("A", D(2020, 1, 1), 1e25), ("A", D(2020, 1, 2), 1.0), ("B", D(2020, 1, 2), 0.1)])
    got = {r.state: r.total for r in panels.monthly_sum(df).collect()}
    assert got == {"A": 1e25, "B": 0.1}


def test_short_series_goes_to_validation_whole(spark):
    df = frame(spark, [("A", d, 1.0) for d in month_ends(2020, 1, 3)] + [("B", d, 1.0) for d in month_ends(2020, 1, 9)])
    report = {r.state: (r.n_train, r.n_val) for r in panels.split_report(panels.train_val_split(df)).collect()}
    assert report == {"A": (0, 3), "B": (3, 6)}


def test_split_sides_do_not_overlap(sample_panel):
    split = panels.train_val_split(sample_panel, 4)
    assert panels.split_overlap(split).first().n_overlap == 0
    last, first = split.selectExpr("max(if(split='train', date, null)) a", "min(if(split='val', date, null)) b").first()
    assert last < first and split.filter("split = 'val'").count() == 4


def test_minimum_periods_and_dropped_states(spark):
    df = frame(spark, [("A", d, 1.0) for d in month_ends(2020, 1, 3)] + [("B", d, 1.0) for d in month_ends(2020, 1, 12)])
    kept = panels.enough_periods(df)
    assert {r.state for r in kept.collect()} == {"B"}
    assert [r.state for r in panels.dropped_series(df).collect()] == ["A"]
    assert {r.state for r in panels.build_monthly_panel(df).collect()} == {"A", "B"}
    assert {r.state for r in panels.build_monthly_panel(df, min_observed=12).collect()} == {"B"}


def test_date_limits_cut_the_panel(sample_panel):
    cut = panels.build_monthly_panel(sample_panel, min_date="2020-03-01", max_date="2021-12-31")
    assert cut.agg(F.min("date"), F.max("date"), F.count("*")).first() == (D(2020, 3, 31), D(2021, 12, 31), 22)


def test_a_stray_year_can_stop_the_job_or_be_cut(spark):
    df = frame(spark, [("A", D(2, 1, 1), 1.0), ("A", D(2020, 1, 1), 1.0), ("A", D(2020, 3, 1), 1.0)])
    with pytest.raises(Exception, match="more than 2400 months"):
        panels.build_monthly_panel(df, min_periods=1, max_months=2400).collect()
    assert panels.build_monthly_panel(df, min_periods=1, min_date="2000-01-01").count() == 3
    assert panels.build_monthly_panel(df, min_periods=1).count() == 2018 * 12 + 3


@pytest.mark.parametrize(
    "dates, freq",
    [
        (month_ends(2020, 1, 4), "ME"),
        ([D(2020, m, 1) for m in (1, 2, 3)], "MS"),
        (month_ends(2020, 1, 2), "default"),
        ([D(2020, 1, 31), D(2020, 3, 31), D(2020, 4, 30)], "default"),
    ],
)
def test_frequency(spark, dates, freq):
    df = frame(spark, [("A", d, 1.0) for d in dates])
    assert panels.infer_frequency(df, "default").first().freq == freq


def test_future_calendar_is_month_ends(sample_panel):
    got = [(r.step, r.date) for r in panels.future_calendar(sample_panel, 3).orderBy("step").collect()]
    assert got == [(1, D(2023, 1, 31)), (2, D(2023, 2, 28)), (3, D(2023, 3, 31))]


def test_series_of_one_state_shows_its_missing_months(spark):
    df = frame(spark, [("A", D(2020, 1, 31), 1.0), ("A", D(2020, 3, 31), 2.0), ("B", D(2019, 1, 31), 5.0)])
    assert [r.total for r in panels.series_of(df, "A").orderBy("date").collect()] == [1.0, None, 2.0]


def test_tail_split_keeps_at_least_one(spark):
    df = frame(spark, [("A", d, 1.0) for d in month_ends(2020, 1, 3)] + [("B", d, 1.0) for d in month_ends(2020, 1, 11)])
    got = {r.state: r.n for r in panels.tail_split(df).filter("part='val'").groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 1, "B": 2}
