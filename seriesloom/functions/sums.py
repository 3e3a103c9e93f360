"""Sums of doubles that lose nothing from 2^-100 up and do not depend on the order of rows or tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two at which a value is cut into whole numbers.
CUTS = (50, 20, -10, -40, -70, -100)


def exact_sum_sql(value: str) -> str:
    """SQL text of the sum of a double column, the same text for any engine with an exact remainder.

    A value is cut into whole multiples of 2^50, 2^20 and so on down to 2^-100 by remainders, which are
    exact. The multiples are added as numbers of their own: the highest as doubles, which are whole
    and so exact up to 2^53, the others, below 2^30 each, as long integers, which hold eight thousand million of
    them; more raise an error. What a value holds below 2^-100 is dropped. The parts are put together from the smallest up. NULL when no value is
    present; a value that is not finite makes the sum not finite.
    """
    return joined_parts(exact_part_sqls(value))


def exact_part_sqls(value: str) -> list[str]:
    """SQL texts of the sums of the multiples, highest first, each a double; parts of separate rows may be added up later."""
    sizes = [f"{2.0 ** cut:.17e}" for cut in CUTS]
    parts = [f"sum(({value} - {value} % {sizes[0]}) / {sizes[0]}) * {sizes[0]}"]
    for above, size in zip(sizes, sizes[1:]):
        whole = f"({value} % {above} - {value} % {size}) / {size}"
        parts.append(f"CAST(sum(CAST(CASE WHEN isnan({value} % {above}) THEN 0 ELSE {whole} END AS BIGINT)) AS DOUBLE) * {size}")
    return parts


def joined_parts(parts: list[str]) -> str:
    """SQL text of the total of parts, added from the smallest up."""
    total = parts[-1]
    for part in reversed(parts[:-1]):
        total = f"({total} + {part})"
    return total


def exact_sum(value: str) -> Column:
    return F.expr(exact_sum_sql(value))
