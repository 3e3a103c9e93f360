"""Text to typed values: mixed-format dates, money strings, column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a missing cell in a delimited file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

WHITESPACE = " \t\n\r\x0b\x0c"

# A hyphen means day first, a slash means month first; the second format of a
# pair catches values whose first reading is not a calendar date. Year-first text is read last.
DATE_LAYOUTS = [
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
]
CLOCK_SUFFIX = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"

# Digits may be grouped by single underscores, as in Python number literals.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TOKENS), text)


def parse_date(text: Column) -> Column:
    """Date of a mixed-format string, NULL when no layout fits.

    The layout test comes first, so a row pays for one or two parse attempts, not for all.
    """
    trimmed = F.regexp_replace(F.btrim(text, F.lit(WHITESPACE)), CLOCK_SUFFIX, "")
    parsed = F.lit(None).cast("date")
    for layout, formats in reversed(DATE_LAYOUTS):
        attempts = [F.try_to_timestamp(trimmed, F.lit(fmt)).cast("date") for fmt in formats]
        parsed = F.when(trimmed.rlike(layout), F.coalesce(*attempts)).otherwise(parsed)
    return parsed


def parse_money(text: Column) -> Column:
    """Number behind a money string (grouping commas and blanks removed), NULL when invalid."""
    bare = F.regexp_replace(text, r"[,\s]", "")
    value = F.regexp_replace(bare, "_", "").try_cast("double")
    return F.when(bare.rlike(NUMBER) & (F.abs(value) < F.lit(float("inf"))), value)


def normalized_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")
