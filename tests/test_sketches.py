"""Sketches that unite, and counts that are taken while rows are written."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from seriesloom.operators import cleaning, sketches
from seriesloom.sources import sales as src


def sold(spark, n):
    return spark.range(n).selectExpr(
        "concat('s', id % 3) as state", "date_add(date'2020-01-01', cast(id % 700 as int)) as date",
        "if(id % 50 = 0, null, cast(xxhash64(id % 40000) as bigint)) as customer",
    )


def test_united_sketches_estimate_like_the_sketch_of_all_rows(spark):
    rows = sold(spark, 120_000)
    early, late = rows.filter("date < '2020-11-15'"), rows.filter("date >= '2020-11-15'")
    kept = sketches.merged(sketches.monthly_sketches(early, "customer"), sketches.monthly_sketches(late, "customer"))
    got = {(r.state, str(r.date)): r.n for r in kept.select("state", "date", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    whole = sketches.monthly_sketches(rows, "customer")
    direct = {(r.state, str(r.date)): r.n for r in whole.select("state", "date", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert got.keys() == direct.keys() and {k for k in got if got[k] != direct[k]} <= {(f"s{i}", "2020-11-30") for i in range(3)}
    assert all(abs(got[k] - direct[k]) < 0.02 * direct[k] for k in got)
    united = {r.state: r.n_distinct for r in sketches.united(kept, ["state"]).collect()}
    once = rows.groupBy("state").agg(F.hll_sketch_estimate(F.hll_sketch_agg("customer", F.lit(12))).alias("n"), F.countDistinct("customer").alias("true"))
    for r in once.collect():
        assert abs(united[r.state] - r.true) < 0.05 * r.true and abs(r.n - united[r.state]) < 0.02 * r.true


def test_small_counts_are_exact_and_nulls_do_not_count(spark):
    rows = sold(spark, 900)
    got = {r.state: r.n_distinct for r in sketches.united(sketches.monthly_sketches(rows.withColumn("customer", F.col("customer") % 60), "customer"), ["state"]).collect()}
    want = {r.state: r.n for r in rows.groupBy("state").agg(F.countDistinct(F.col("customer") % 60).alias("n")).collect()}
    assert got == want
    assert sketches.monthly_sketches(rows.limit(0), "customer").count() == 0


def test_merged_values_count_like_all_rows(spark):
    """Months that come in two pieces, one month in both; NULL values, dates and states as SQL groups and counts them."""
    rows = sold(spark, 60_000).unionByName(spark.createDataFrame(
        [("s0", None, 7), ("s0", None, 7), (None, "2020-03-05", 8), ("s9", "2020-03-05", None)], "state string, date string, customer long",
    ).withColumn("date", F.to_date("date")))
    late = F.coalesce(F.col("date") >= "2020-11-15", F.lit(False))
    early, late = (sketches.monthly_values(rows.filter(part), "customer") for part in (~late, late))
    by = ["state", F.year("date").alias("year")]
    got = {tuple(r) for r in sketches.counted(sketches.merged_values(early, late), by).collect()}
    assert got == {tuple(r) for r in rows.groupBy(*by).agg(F.countDistinct("customer")).collect()}
    assert {("s0", None, 1), (None, 2020, 1), ("s9", 2020, 0)} <= got and max(n for *_, n in got) > 5000
    assert sketches.merged_values(early, early).count() == early.count()


def test_query_counts_large_groups_like_its_sql(spark, tmp_path):
    """Thousands of customers in a state and year, where a sketch would only estimate; some orders have no date, and a third
    are of one customer, who comes once a day to the join."""
    tables = {
        "nation": spark.range(2).selectExpr("cast(id as int) as n_nationkey", "concat('n', id) as n_name", "0 as n_regionkey"),
        "customer": spark.range(9000).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey"),
        "orders": spark.range(40_000).selectExpr(
            "id as o_orderkey", "if(id % 3 = 0, 7, pmod(xxhash64(id), 9000)) as o_custkey", "1.0D as o_totalprice",
            "if(id % 1000 = 0, null, cast(date_add(date'2020-01-01', cast(id % 700 as int)) as timestamp_ntz)) as o_orderdate",
        ),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(entry_points.oracle_sql()["distinct_sketches"]).fetchall()
    got = entry_points.queries()["distinct_sketches"](spark, str(tmp_path)).select("state", "year", "n_distinct")
    assert {tuple(r) for r in got.collect()} == set(want) and len(want) == 6
    assert src.customer_sales(spark, str(tmp_path)).filter("customer = 7").count() == 701


def test_counts_of_the_written_pass_equal_the_report(spark, tmp_path):
    rows = [
        (1, "A", "2020-01-05", "10"), (2, "A", "2020-01-05", "11"), (3, "A", "nothing", "12"), (4, "B", "1/12/2019", "n/a"),
        (5, "B", "31-01-2021", " 1,000 "), (6, None, "2020-01-05", "3"), (7, "B", None, None),
    ]
    raw = spark.createDataFrame(rows, "rid long, state string, date string, total string")
    counts = cleaning.write_clean(raw, str(tmp_path / "clean"))
    report = cleaning.quality_report(raw).first().asDict()
    assert counts == {k: v for k, v in report.items() if k != "n_states"}
    clean, *_ = cleaning.observed_counts(raw.union(raw))
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("CollectMetrics") == 2
