import os
import sys

import numpy as np
import pytest
from months import month_ends

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", memory="6g")


@pytest.fixture(scope="session")
def sample_values():
    at = np.arange(36)
    return 800_000 + 9_000 * at + 150_000 * np.cos(np.pi * (at - 11) / 6) + 700 * (at * 37 % 41)


@pytest.fixture(scope="session")
def sample_panel(spark, sample_values):
    rows = [("S0", d, float(v)) for d, v in zip(month_ends(2020, 1, 36), sample_values)]
    return spark.createDataFrame(rows, "state string, date date, total double").cache()


@pytest.fixture(scope="session")
def long_panel(spark):
    """Three series of 84 months: seasonal with growth, seasonal around a level, a straight line."""
    dates = month_ends(2017, 1, 84)
    at = np.arange(84)
    season = np.sin(2 * np.pi * at / 12)
    series = {
        "grow": 1000 + 5 * at + 100 * season,
        "wave": 500 + 200 * season,
        "line": 100 + 2.0 * at,
    }
    rows = [(s, d, float(v)) for s, values in series.items() for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, "state string, date date, total double").cache()
