import pandas as pd

import __spark_entry__ as entry_points
from seriesloom.operators.panel import build_monthly_panel, monthly_sum

SF = "/root/testdata/sf0.001"


def test_every_text_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_returns_a_winner_per_state(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["state", "best_model", "step_1", "step_2"] and df.count() == 25


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_source_joins_do_not_depend_on_broadcast(spark):
    """With dimensions too large to broadcast both sides are shuffled, with the same sums."""
    small = {tuple(r) for r in entry_points.queries()["monthly_sum"](spark, SF).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry_points.queries()["monthly_sum"](spark, SF)
        assert {tuple(r) for r in df.collect()} == small
        assert "BroadcastExchange" not in final_plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duplicates_are_reduced_before_the_shuffle(spark):
    """A (state, date) with a third of the rows leaves each task as one row."""
    plan = final_plan(entry_points.queries()["clean_sales"](spark, SF))
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning") and "Window" not in plan


def test_scans_read_only_the_columns_in_use(spark):
    plan = final_plan(entry_points.queries()["min_periods"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_one_hot_state_gives_the_same_panel(spark):
    """A third of all observations under one state and one day."""
    many = spark.range(30_000).selectExpr(
        "id as rid",
        "if(id < 10000, 'hot', concat('s', id % 40)) as state",
        "if(id < 10000, date'2020-01-15', date_add(date'2019-06-01', cast(id % 700 as int))) as date",
        "cast(id % 97 as double) as total",
    )
    got = {(r.state, r.date): r.total for r in monthly_sum(many).collect()}
    pdf = many.toPandas()
    pdf["month"] = pd.to_datetime(pdf["date"]) + pd.offsets.MonthEnd(0)
    want = pdf.groupby(["state", "month"])["total"].sum()
    assert got == {(s, m.date()): float(v) for (s, m), v in want.items()}
    panel = build_monthly_panel(many)
    sizes = {r["count"] for r in panel.groupBy("state").count().collect()}
    assert len(sizes) == 1 and panel.filter("state = 'hot' and observed").count() == 1
