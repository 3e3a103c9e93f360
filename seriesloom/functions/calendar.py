"""Month arithmetic, calendar features, Fourier terms and the US federal holiday rules.

Longer expressions are written as SQL text: one call builds the whole expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONDAY, THURSDAY = 0, 3
LAST = 5

# US federal holidays. Day-of-month holidays as (first year, name, month, day);
# they are also kept on the nearest weekday when they fall on a weekend.
FIXED_HOLIDAYS = [
    (1, "New Year's Day", 1, 1),
    (2021, "Juneteenth National Independence Day", 6, 19),
    (1, "Independence Day", 7, 4),
    (1, "Veterans Day", 11, 11),
    (1, "Christmas Day", 12, 25),
]
# Weekday holidays as (first year, name, month, weekday, occurrence).
WEEKDAY_HOLIDAYS = [
    (1986, "Martin Luther King Jr. Day", 1, MONDAY, 3),
    (1, "Washington's Birthday", 2, MONDAY, 3),
    (1, "Memorial Day", 5, MONDAY, LAST),
    (1, "Labor Day", 9, MONDAY, 1),
    (1, "Columbus Day", 10, MONDAY, 2),
    (1, "Thanksgiving", 11, THURSDAY, 4),
]


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def months_after(date: str, steps: str | int) -> Column:
    """Month end that lies ``steps`` months after the month of ``date``."""
    return F.expr(f"last_day(add_months(trunc({date}, 'month'), {steps}))")


def month_angle(date: str) -> str:
    return f"(month({date}) * {2 * math.pi!r}D / 12)"


def fourier_pairs(date: str, order: int) -> dict[str, Column]:
    """Yearly sine and cosine terms by harmonic."""
    terms: dict[str, Column] = {}
    for k in range(1, order + 1):
        terms[f"sin_{k}"] = F.expr(f"sin({month_angle(date)} * {k})")
        terms[f"cos_{k}"] = F.expr(f"cos({month_angle(date)} * {k})")
    return terms


def _nth_weekday(year: str, month: int, weekday: int, occurrence: int) -> str:
    first = f"make_date({year}, {month}, 1)"
    if occurrence == LAST:
        last = f"last_day({first})"
        return f"date_sub({last}, pmod(weekday({last}) - {weekday}, 7))"
    return f"date_add({first}, pmod({weekday} - weekday({first}), 7) + {7 * (occurrence - 1)})"


def _entry(date: str, name: str, when: str = "true") -> str:
    quoted = name.replace("'", "\\'")
    return f"if({when}, named_struct('date', {date}, 'name', '{quoted}'), null)"


def _holidays(year: str) -> str:
    """SQL text of the array of (date, name) for one year, kept-on weekdays included."""
    entries = []
    for since, name, month, day in FIXED_HOLIDAYS:
        date = f"make_date({year}, {month}, {day})"
        kept = f"date_add({date}, case weekday({date}) when 5 then -1 when 6 then 1 end)"
        entries.append(_entry(date, name, f"{year} >= {since}"))
        entries.append(_entry(kept, f"{name} (observed)", f"{year} >= {since} and year({kept}) = {year}"))
    next_new_year = f"make_date({year} + 1, 1, 1)"
    entries.append(
        _entry(f"date_sub({next_new_year}, 1)", "New Year's Day (observed)", f"weekday({next_new_year}) = 5")
    )
    for since, name, month, weekday, occurrence in WEEKDAY_HOLIDAYS:
        entries.append(_entry(_nth_weekday(year, month, weekday, occurrence), name, f"{year} >= {since}"))
    return f"array_compact(array({', '.join(entries)}))"


def holiday_calendar(years: DataFrame) -> DataFrame:
    """Holiday dimension ``(date, name)`` for a table of distinct years."""
    return years.select(F.expr(f"inline({_holidays('year')})"))


def _first_years() -> dict[int, int]:
    """First year with a holiday, per month. A kept-on weekday stays in its month, but for
    New Year's Day on a Saturday, and the December it moves to has Christmas."""
    years: dict[int, int] = {}
    for since, _, month, *_ in [*FIXED_HOLIDAYS, *WEEKDAY_HOLIDAYS]:
        years[month] = min(since, years.get(month, since))
    return years


def is_holiday_month(date: str) -> Column:
    """1 when any holiday lies in the month of ``date``.

    Read off the months of the rules: no join, and nothing but integer tests per row.
    """
    tests = " ".join(f"when {month} then year({date}) >= {since}" for month, since in sorted(_first_years().items()))
    return F.expr(f"cast(case month({date}) {tests} else false end as int)")


HOLIDAY_NAMES = [name for _, name, *_ in [*FIXED_HOLIDAYS, *WEEKDAY_HOLIDAYS]]


def holiday_days(date: str) -> dict[str, Column]:
    """Days of each holiday in the month of ``date``, by name, kept-on weekdays included; no join."""
    days: dict[str, Column] = {}
    year = f"year({date})"
    for since, name, month, day in FIXED_HOLIDAYS:
        own = f"make_date({year}, {month}, {day})"
        kept = f"date_add({own}, case weekday({own}) when 5 then -1 when 6 then 1 end)"
        count = f"if(month({date}) = {month} and {year} >= {since}, 1 + cast(coalesce(month({kept}) = {month}, false) as int), 0)"
        if (month, day) == (1, 1):
            count += f" + if(month({date}) = 12 and weekday(make_date({year} + 1, 1, 1)) = 5, 1, 0)"
        days[name] = F.expr(count)
    for since, name, month, *_ in WEEKDAY_HOLIDAYS:
        days[name] = F.expr(f"if(month({date}) = {month} and {year} >= {since}, 1, 0)")
    return days
