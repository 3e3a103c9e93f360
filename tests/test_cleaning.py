import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.parsing import parse_date, parse_money
from seriesloom.operators import cleaning
from seriesloom.sources.delimited import scan_csv


def d(text):
    return datetime.date.fromisoformat(text) if text else None


DATES = {
    "31-01-2021": "2021-01-31",
    "1/12/2019": "2019-01-12",
    "01-31-2021": "2021-01-31",
    "31/01/2021": "2021-01-31",
    "2021-01-31": "2021-01-31",
    " 2021/1/5\t": "2021-01-05",
    "2021-01-31 10:30:00": "2021-01-31",
    "30-02-2021": None,
    "13-13-2021": None,
    "": None,
    "not a date": None,
    None: None,
}

TOTALS = {
    "  109,574,036 ": 109574036.0,
    "5d": None,
    "inf": None,
    "nan": None,
    "1_000": 1000.0,
    "$5": None,
    "(5)": None,
    "+5": 5.0,
    "-2.50": -2.5,
    "1e3": 1000.0,
    ".5": 0.5,
    "7.": 7.0,
    "_1": None,
    "1__0": None,
    "1e999": None,
    "": None,
    None: None,
}


def test_dates_in_mixed_layouts(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string")
    got = {r.s: r.v for r in df.select("s", parse_date(F.col("s")).alias("v")).collect()}
    assert got == {k: d(v) for k, v in DATES.items()}


def test_money_strings(spark):
    df = spark.createDataFrame([(k,) for k in TOTALS], "s string")
    got = {r.s: r.v for r in df.select("s", parse_money(F.col("s")).alias("v")).collect()}
    assert got == TOTALS


def test_missing_column_is_reported_at_once(spark):
    df = spark.createDataFrame([("A", "1/1/2020")], "state string, date string")
    with pytest.raises(KeyError):
        cleaning.clean_observations(df)


def test_first_row_wins_even_when_its_total_is_missing(spark):
    rows = [(2, "A", "1/1/2020", "5"), (1, "A", "01-01-2020", "n/a"), (3, "A", "2/1/2020", "7"), (4, "B", "bad", "1")]
    raw = spark.createDataFrame(rows, "rid long, state string, date string, total string")
    got = {(r.state, r.date): r.total for r in cleaning.clean_observations(raw).collect()}
    assert got == {("A", d("2020-01-01")): None, ("A", d("2020-02-01")): 7.0}


def test_dedupe_keeps_other_columns_of_the_same_row(spark):
    rows = [(2, "A", 1, "x", 9.0), (1, "A", 1, None, 8.0)]
    df = spark.createDataFrame(rows, "rid long, state string, date int, note string, total double")
    assert [tuple(r) for r in cleaning.dedupe_first(df).collect()] == [("A", 1, None, 8.0)]


def test_quality_counts(spark):
    rows = [
        (1, "A", "1/1/2020", "5"),
        (2, "A", "1/1/2020", "6"),
        (3, "A", "bad", "x"),
        (4, "B", "2/1/2020", "x"),
        (5, None, "2/1/2020", "1"),
    ]
    raw = spark.createDataFrame(rows, "rid long, state string, date string, total string")
    got = cleaning.quality_report(raw).first().asDict()
    assert got == {
        "n_rows_raw": 5,
        "n_bad_dates": 1,
        "n_bad_totals": 1,
        "n_duplicates": 1,
        "n_rows_clean": 3,
        "n_states": 2,
        "min_date": d("2020-01-01"),
        "max_date": d("2020-02-01"),
    }


def test_csv_scan_keeps_text_and_file_order(spark, tmp_path):
    lines = [" State,DATE,Total ,Extra Col"] + [f'S,1/1/2020,"{i:,}",k{i}' for i in range(2000)] + ["NA,,n/a,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(" State,DATE,Total ,Extra Col\nS,1/1/2020,-1,last\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = cleaning.normalize_columns(scan_csv(spark, str(tmp_path)))
        assert raw.columns == ["state", "date", "total", "extra_col", "rid"]
        assert raw.filter("state is null and date is null and total is null and extra_col is null").count() == 1
        clean = cleaning.clean_observations(raw.filter("state is not null"))
        assert [tuple(r) for r in clean.collect()] == [("S", d("2020-01-01"), 0.0, "k0")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sums_lose_nothing_and_have_no_order(spark):
    import math

    from seriesloom.functions.sums import exact_sum

    groups = {
        "small": [1e-7, 2e-7],
        "mixed": [1e15, 1e-7, -1e15, 0.1, 0.2],
        "large": [1e15, 1.0, 3e15, 0.25],
        "huge": [1e300, 1.0],
        "cents": [0.01 * i for i in range(1, 400)],
        "none": [None, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("nan", float("nan")), ("nan", 1.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    made = [{r.g: r.s for r in df.groupBy("g").agg(exact_sum("v").alias("s")).collect()} for df in (frame, frame.orderBy("v").repartition(7))]
    assert made[0].pop("nan") != made[1].pop("nan") and made[0] == made[1]
    for g, values in groups.items():
        want = None if values[0] is None else math.fsum(values)
        assert made[0][g] == want or abs(made[0][g] - want) <= 2 * math.ulp(want), g


def test_csv_rows_are_deduplicated_by_a_hash_aggregate(spark, tmp_path):
    """The first row by file, then by place; the order is one number of fixed width."""
    folder = tmp_path / "a b%25ü"
    folder.mkdir()
    for k in range(3):
        lines = "".join(f"s{i % 5},2020-01-{i % 3 + 1:02d},{100 * k + i}\n" for i in range(40))
        (folder / f"f {k}.csv").write_text("state,date,total\n" + lines)
    clean = cleaning.clean_observations(scan_csv(spark, str(folder)))
    got = {(r.state, r.date.day): r.total for r in clean.collect()}
    assert got == {(f"s{i % 5}", i % 3 + 1): float(i) for i in reversed(range(40))}
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
