import datetime

import numpy as np
import pandas as pd
from months import month_ends
from pyspark.sql import functions as F

from seriesloom.functions.calendar import holiday_calendar
from seriesloom.operators import analysis, features, panel as panels


def test_features_follow_pandas(sample_panel, sample_values):
    got = features.build_features(sample_panel).orderBy("date").toPandas()
    s = pd.Series(sample_values)
    for k in (1, 2, 3, 6, 12):
        np.testing.assert_allclose(got[f"lag_{k}"], s.shift(k))
    for k in (3, 6, 12):
        np.testing.assert_allclose(got[f"rolling_mean_{k}"], s.shift(1).rolling(k).mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"rolling_std_{k}"], s.shift(1).rolling(k).std(), rtol=1e-6)
    np.testing.assert_allclose(got["yoy_growth"], s.pct_change(12))
    assert list(got["trend"]) == list(range(36))
    assert list(got["month"][:3]) == [1, 2, 3] and list(got["quarter"][:4]) == [1, 1, 1, 2]
    np.testing.assert_allclose(got["sin_month"], np.sin(2 * np.pi * got["month"] / 12), atol=1e-12)
    assert len(got.columns) == 2 + 1 + 19


def test_supervised_rows_are_complete(sample_panel):
    made = features.prepare_supervised(features.build_features(sample_panel))
    assert made.count() == 24
    assert made.filter(" or ".join(f"`{c}` is null" for c in made.columns)).count() == 0


def test_model_features_have_eighteen_columns(sample_panel):
    made = features.model_features(sample_panel)
    assert len(features.feature_names()) == 18 and made.columns[3:] == features.feature_names()
    assert "holiday_month" not in made.columns and made.count() == 24


def test_growth_on_a_zero_base_is_missing(spark):
    rows = [("A", d, 0.0 if i == 0 else 5.0) for i, d in enumerate(month_ends(2020, 1, 14))]
    df = spark.createDataFrame(rows, "state string, date date, total double")
    got = [r.yoy_growth for r in features.build_features(df).orderBy("date").collect()]
    assert got[:12] == [None] * 12 and got[12] is None and got[13] == 0.0


def test_history_features_equal_window_features(sample_panel):
    """The recursive path and the table path give the same row for the same month."""
    cut = sample_panel.filter(F.col("date") < "2022-12-01")
    table = features.model_features(sample_panel, known_growth_only=True).filter("date = '2022-12-31'").first()
    memory = features.series_memory(cut, 13).withColumn("next", F.lit(datetime.date(2022, 12, 31)))
    made = features.features_from_history("history", "next", "n", known_growth_only=True)
    row = memory.select(*[F.expr(f"{text} as {name}") for name, text in made.items()]).first()
    for name in features.feature_names():
        np.testing.assert_allclose(row[name], table[name], rtol=1e-9, err_msg=name)


def test_next_step_repeats_the_last_value_for_growth(sample_panel, sample_values):
    row = features.next_step_features(sample_panel).first()
    assert row.date == datetime.date(2023, 1, 31) and row.trend == 36
    np.testing.assert_allclose(row.lag_1, sample_values[-1])
    np.testing.assert_allclose(row.yoy_growth, sample_values[-1] / sample_values[-12] - 1)


def test_scaling_uses_training_rows_only_and_inverts(sample_panel, sample_values):
    scaled = features.min_max_scale(panels.train_val_split(sample_panel, 6))
    row = scaled.select("lo", "rng").distinct().collect()
    assert len(row) == 1 and row[0].lo == sample_values[:30].min()
    back = scaled.select(F.max(F.abs(features.inverse_scale(F.col("z"), F.col("lo"), F.col("rng")) - F.col("total")))).first()[0]
    assert back < 1e-6
    train = scaled.filter("split = 'train'").agg(F.min("z"), F.max("z")).first()
    assert train[0] == 0.0 and abs(train[1] - 1) < 1e-9


def test_sequences_have_the_lookback_length(sample_panel):
    made = features.make_sequences(features.min_max_scale(panels.train_val_split(sample_panel)), 6)
    assert made.count() == 30 and {r.n for r in made.select(F.size("x").alias("n")).distinct().collect()} == {6}


def test_holidays_of_known_years(spark):
    years = spark.createDataFrame([(2021,), (2010,), (2020,)], "year int")
    got = {}
    for r in holiday_calendar(years).collect():
        got.setdefault(r.date.year, {})[r.name] = r.date
    D = datetime.date
    assert got[2021]["Martin Luther King Jr. Day"] == D(2021, 1, 18)
    assert got[2021]["Washington's Birthday"] == D(2021, 2, 15)
    assert got[2021]["Memorial Day"] == D(2021, 5, 31)
    assert got[2021]["Juneteenth National Independence Day (observed)"] == D(2021, 6, 18)
    assert got[2021]["Independence Day (observed)"] == D(2021, 7, 5)
    assert got[2021]["Labor Day"] == D(2021, 9, 6)
    assert got[2021]["Columbus Day"] == D(2021, 10, 11)
    assert got[2021]["Thanksgiving"] == D(2021, 11, 25)
    assert got[2021]["New Year's Day (observed)"] == D(2021, 12, 31)
    assert got[2010]["New Year's Day (observed)"] == D(2010, 12, 31)
    assert "Juneteenth National Independence Day" not in got[2020]


def test_holiday_months_by_era(spark):
    dates = month_ends(2020, 1, 24)
    df = spark.createDataFrame([("A", d, 1.0) for d in dates], "state string, date date, total double")
    got = {r.date: r.holiday_month for r in features.build_features(df).collect()}
    for day, flag in got.items():
        always = day.month in (1, 2, 5, 7, 9, 10, 11, 12)
        assert flag == int(always or (day.month == 6 and day.year >= 2021)), day


def test_decomposition_recovers_a_known_pattern(spark):
    pattern = np.array([0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7])
    trend = 100 + 2.0 * np.arange(48)
    rows = [("A", d, float(t * pattern[i % 12])) for i, (d, t) in enumerate(zip(month_ends(2019, 1, 48), trend))]
    rows += [("short", d, 1.0) for d in month_ends(2019, 1, 20)]
    rows += [("zero", d, float(i)) for i, d in enumerate(month_ends(2019, 1, 48))]
    df = spark.createDataFrame(rows, "state string, date date, total double")
    made = analysis.seasonal_decompose(df).orderBy("date").toPandas()
    assert made.groupby("state").size().to_dict() == {"A": 48, "short": 20, "zero": 48}
    reasons = made.drop_duplicates("state").set_index("state").reason.to_dict()
    assert reasons == {"A": None, "short": "fewer than 24 months", "zero": "a value of 0 or less"}
    assert made[made.state != "A"][["trend", "seasonal", "residual"]].isna().all(axis=None)
    got = made[made.state == "A"].reset_index(drop=True)
    assert got.trend.isna().sum() == 12
    np.testing.assert_allclose(got.seasonal[:12], pattern / pattern.mean(), rtol=0.02)
    x = pd.Series(trend * pattern[np.arange(48) % 12])
    centred = x.rolling(12).mean().rolling(2).mean().shift(-6)
    np.testing.assert_allclose(got.trend, centred, rtol=1e-9)


def test_stationarity_of_noise_and_of_a_walk(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=80), np.cumsum(rng.normal(size=80))
    dates = month_ends(2015, 1, 80)
    rows = [("noise", d, float(v)) for d, v in zip(dates, noise)] + [("walk", d, float(v)) for d, v in zip(dates, walk)]
    rows += [("flat", d, 1.0) for d in dates]
    df = spark.createDataFrame(rows, "state string, date date, total double")
    got = {r.state: r for r in analysis.df_test(df).collect()}
    assert got["noise"].stationary and not got["walk"].stationary and not got["flat"].stationary
    y, x = np.diff(walk), walk[:-1]
    design = np.column_stack([np.ones(79), x])
    b, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(sse[0] / 77 * np.linalg.inv(design.T @ design)[1, 1])
    np.testing.assert_allclose(got["walk"].t_stat, b[1] / se, rtol=1e-9)


def test_exploratory_tables(sample_panel):
    report = analysis.exploratory_report(sample_panel)
    assert report["summary"].first().n_rows == 36
    assert report["seasonality"].count() == 3 and report["aggregate_trend"].count() == 36
