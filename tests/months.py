"""Month ends for the tests' series."""

import datetime


def month_end(year, month):
    first = datetime.date(year + month // 12, month % 12 + 1, 1)
    return first - datetime.timedelta(days=1)


def month_ends(year, month, n):
    return [month_end(year + (month - 1 + i) // 12, (month - 1 + i) % 12 + 1) for i in range(n)]
