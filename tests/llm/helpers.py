"""Small tables and plain versions that the tests compare with."""

import re

LONG = "zwei worte " * 3000 + "x" * 40_000

#: NULLs, empty and blank texts, a very long one, repeated rows; the extra columns clash with results.
ODD_TEXTS = [
    (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "no id here"), (6, "é ß 日本 🙂"),
    (1, "one two three four five six"), (7, "Hi"), (None, None),
]
CLASHING = "score double, predicted string, id long, text_ string, n long, node string, _score string, key int"


def documents(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return docs
    names = [c.split()[0] for c in CLASHING.split(", ")]
    kinds = [c.split()[1] for c in CLASHING.split(", ")]
    return docs.selectExpr("*", *(f"cast(null as {k}) as {n}" for n, k in zip(names, kinds)))


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def smallest_reachable(ids, links):
    """The smallest id reachable from each id."""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}
