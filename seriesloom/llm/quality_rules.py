"""Rules on whole texts: a table of thresholds, compiled into one Spark projection.

``measured`` turns a text into counts with built-in functions only. A ``Rule`` compares two of them as
whole numbers, ``100 * part`` against ``percent * whole``, so there is no rounding; ``verdicts`` turns a table of
rules into one projection. Nothing is shuffled, and a document is judged where it was read.

Windows of eight words are compared by two 64-bit hashes over the hashes of their words. Only a text in which some
window occurs twice sorts its windows; memory is a small multiple of the longest text of a task.

Defined cases: a NULL text has no words, like an empty one, and fails; NULL ids and repeated rows are judged each;
ties do not arise; an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window whose repetition counts.
WINDOW = 8

# The commonest words of four languages.
STOP_WORDS = (
    "the of and to a in is it that was for on are with as by at from this be "
    "der die das und ist nicht ein den von zu mit sich auf für im dem auch als "
    "le la les de et un une des que est en du dans qui pas pour au sur "
    "el los las y del se por con no una su para al lo"
).split()
#: Characters that may follow a stop word.
AFTER = ".,;:!?"
SPACE, SYMBOL, CAPITAL = r"[\x20\x09-\x0D]+", "[#*$%&|<>]", "[A-Z]"


@dataclass(frozen=True)
class Rule:
    """A text keeps to it if ``100 * part`` is at least ``least`` and at most ``most`` per cent of ``whole``."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        """True where the rule is broken. Without ``whole`` the limits are plain counts."""
        part, whole = (F.col(self.part) * 100, F.col(self.whole)) if self.whole else (F.col(self.part), F.lit(1))
        limits = []
        if self.least is not None:
            limits.append(part < whole * self.least)
        if self.most is not None:
            limits.append(part > whole * self.most)
        return limits[0] if len(limits) == 1 else limits[0] | limits[1]


#: What fails a text whatever the method says.
BASE_RULES = (
    Rule("few_words", "n_words", least=20),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=30),
)
RULES = (
    Rule("many_words", "n_words", most=1_000_000),
    Rule("word_length", "word_chars", "n_words", least=300, most=1_200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("letters", "n_letter_words", "n_words", least=75),
    Rule("stop_words", "n_stop_words", "n_words", least=6),
    Rule("capitals", "n_capitals", "word_chars", most=30),
    Rule("stutter", "n_same_words", "n_words", most=15),
    Rule("copied_lines", "n_dup_lines", "n_lines", most=40),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30),
)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, SPACE), "")


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """``rows``, whose column ``words`` is a list, with n_repeat_words: how many words lie in a window of ``WINDOW``
    words that occurs twice or more. Each step is a projection, so that no step is computed twice."""
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    enough = F.size("words") > WINDOW

    def hashes(seed: int) -> Column:
        return F.transform("words", lambda w: F.xxhash64(F.lit(seed), w))

    def key(i: Column, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *(F.get("_h", i + k) for k in range(WINDOW)))

    def same(i: Column, j: Column) -> Column:
        x, y = F.get("_rows", i), F.get("_rows", j)
        return (x["a"] == y["a"]) & (x["b"] == y["b"])

    row = lambda i: F.struct(F.get("_a", i).alias("a"), key(i, 4).alias("b"), i.alias("at"))
    twin = lambda i: F.when(i > 0, same(i, i - 1)).otherwise(F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
    step = lambda i: F.least(F.coalesce(F.get("_at", i + 1) - F.get("_at", i), F.lit(WINDOW)), F.lit(WINDOW))
    rows = rows.withColumn("_h", F.when(enough, hashes(1))).withColumn("_a", F.transform(places, lambda i: key(i, 3)))
    # only texts in which two windows agree go on
    rows = rows.withColumn("_a", F.when(F.size(F.array_distinct("_a")) < F.size("_a"), F.col("_a")))
    rows = rows.withColumn("_h", F.when(F.col("_a").isNotNull(), hashes(2)))
    rows = rows.withColumn("_rows", F.array_sort(F.transform(F.when(F.col("_a").isNotNull(), places), row)))
    rows = rows.withColumn("_hit", F.filter(F.when(F.col("_rows").isNotNull(), places), twin))
    rows = rows.withColumn("_at", F.array_sort(F.transform("_hit", lambda i: F.get("_rows", i)["at"])))
    total = F.aggregate(F.sequence(F.lit(0), F.size("_at") - 1), F.lit(0), lambda n, i: n + step(i))
    found = F.when(F.size("_at") > 0, total).otherwise(F.lit(0))
    return rows.withColumn("n_repeat_words", found).drop("_h", "_a", "_rows", "_hit", "_at")


def measured(texts: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Rows (id, text) with the counts that rules compare in place of the text, all of type long."""
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    t, words, lines = F.col("text"), F.col("words"), F.col("lines")
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", "text", words_of(t).alias("words"), F.filter(F.split(t, "\n"), has_word).alias("lines"))
    rows = with_repeated_words(rows)
    is_stop = lambda w: F.lower(F.rtrim(w, F.lit(AFTER))).isin(list(stop_words))
    after = F.when(F.size(words) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(words) - 1))
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_lines": F.size(lines),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.filter(words, is_stop)),
        "n_capitals": F.regexp_count(t, F.lit(CAPITAL)),
        "n_same_words": F.size(F.filter(after, lambda i: F.get(words, i) == F.get(words, i - 1))),
        "n_bullet_lines": F.size(F.filter(lines, lambda s: s.rlike(r"^[ \t]*[-*•‣◦]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda s: s.rlike(r"(\.\.\.|…)[ \t\r]*$"))),
    }
    return rows.select("id", *(value.cast("long").alias(name) for name, value in made.items()))


def verdicts(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules in the order of the table, comma-joined; '' if none is broken."""
    return F.concat_ws(",", *(F.when(rule.broken(), F.lit(rule.name)) for rule in rules))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES,
          id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per document: the measures, base_failed, kept and the names of all broken rules."""
    counts = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), stop_words)
    names = counts.columns[1:]
    failed = counts.select("*", verdicts(base).alias("_base"), verdicts(rules).alias("_rules"))
    return failed.select(
        F.col("id").alias(id_col), *names,
        (F.col("_base") != "").alias("base_failed"),
        ((F.col("_base") == "") & (F.col("_rules") == "")).alias("kept"),
        F.concat_ws(",", F.nullif("_base", F.lit("")), F.nullif("_rules", F.lit(""))).alias("broken_rules"),
    )
