"""A competition committed group by group: broken off, resumed, with files that nobody committed."""

import pytest
from months import month_ends

from seriesloom.models.registry import BASELINES
from seriesloom.plans import stepwise
from seriesloom.plans.competition import compete
from seriesloom.plans.records import forecast_points
from seriesloom.schema import FORECAST_STORE


class Killed(Exception):
    pass


def panel_of(spark, months, states=24):
    rows = [(f"s{k}", d, float(100 + 3 * k + i * (k % 5) + (i * 7 + k) % 12)) for k in range(states) for i, d in enumerate(month_ends(2018, 1, months))]
    return spark.createDataFrame(rows, "state string, date date, total double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_job_killed_after_three_of_eight_goes_on_with_five(spark, tmp_path):
    path, panel, seen = str(tmp_path / "store"), panel_of(spark, 40), []

    def killed_after_three(group):
        seen.append(group)
        if len(seen) == 3:
            raise Killed

    with pytest.raises(Killed):
        stepwise.compete_in_steps(panel, path, 8, killed_after_three, names=BASELINES)
    half = stepwise.read_steps(spark, path)
    assert {r.g for r in half.select(stepwise.group_of(8).alias("g")).distinct().collect()} == set(seen)
    assert len(stepwise.due_groups(panel, path, 8)) == 5
    assert sorted(stepwise.compete_in_steps(panel, path, 8, names=BASELINES) + seen) == list(range(8))
    want = compete(panel, BASELINES).records
    assert rows_of(forecast_points(stepwise.read_steps(spark, path))) == rows_of(forecast_points(want))
    assert stepwise.compete_in_steps(panel, path, 8, names=BASELINES) == []


def test_files_without_an_entry_are_not_read(spark, tmp_path, monkeypatch):
    """Killed between the records and the manifest, and while records were being written."""
    path, panel = str(tmp_path / "store"), panel_of(spark, 40, 6)
    written = spark.createDataFrame
    calls = []

    def killed(rows, schema=None, *rest, **named):
        if schema == stepwise.MANIFEST and rows:
            calls.append(rows)
            raise Killed
        return written(rows, schema, *rest, **named)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, *a, **k: killed(*a, **k))
        with pytest.raises(Killed):
            stepwise.compete_in_steps(panel, path, 2, names=BASELINES)
    assert calls and stepwise.read_steps(spark, path).count() == 0 and len(stepwise.due_groups(panel, path, 2)) == 2
    stepwise.compete_in_steps(panel, path, 2, names=BASELINES)
    folder = next(r.folder for r in stepwise.manifest(spark, path).collect())
    stray = stepwise.read_steps(spark, path).limit(1)
    stray.write.mode("append").parquet(f"{path}/{folder}")
    stray.write.parquet(f"{path}/data/group=0-stray")
    assert stepwise.read_steps(spark, path).count() == 6


def test_new_data_makes_only_its_groups_due(spark, tmp_path):
    path, panel = str(tmp_path / "store"), panel_of(spark, 40, 8)
    stepwise.compete_in_steps(panel, path, 4, names=BASELINES)
    more = panel_of(spark, 41, 8).filter("state = 's3' or date <= date'2021-04-30'")
    due = stepwise.due_groups(more, path, 4)
    assert due == [r.g for r in more.filter("state = 's3'").select(stepwise.group_of(4).alias("g")).distinct().collect()]
    assert stepwise.compete_in_steps(more, path, 4, names=BASELINES) == due
    got = stepwise.read_steps(spark, path)
    assert got.count() == 8 and str(got.filter("state = 's3'").first().fit_end) == "2021-05-31"


def test_an_unknown_store_is_empty(spark, tmp_path):
    got = stepwise.read_steps(spark, str(tmp_path / "none"))
    assert got.count() == 0 and got.columns == FORECAST_STORE.fieldNames()
