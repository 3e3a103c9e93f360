"""Quality and toxicity: fit, held-out accuracy, odd rows."""

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents
from pyspark.sql import functions as F

from seriesloom.llm import gam, toxicity
from seriesloom.llm.common import crc_remainder, read_table
from seriesloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_tables_follow_main_effects_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.2) | ((x[:, 1] > 0) ^ (x[:, 2] > 0))).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(gam.FEATURES)))
    y = (x[:, 3] > 0).astype(float)
    model = gam.fit(x, y)
    row = x[7]
    total = model.intercept + sum(t[int((e <= v).sum())] for e, t, v in zip(model.edges, model.tables, row))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        total += t[int((model.pair_edges[a] <= row[a]).sum()), int((model.pair_edges[b] <= row[b]).sum())]
    assert model.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_one_class_or_no_labels_give_a_constant(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, ODD_TEXTS)
    model = gam.train(docs, labels, F.lit(True))
    assert {r.score for r in gam.score(docs, model).collect()} == {0.5}
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    assert lexicon.curve == toxicity.Lexicon().curve and toxicity.score(docs, lexicon).count() == len(ODD_TEXTS)
    assert gam.score(documents(spark, []), model).count() == 0
    assert toxicity.score(documents(spark, []), lexicon).count() == 0


@pytest.mark.parametrize("name, label, held", [("op1_quality", "quality", (5, 0)), ("op7_toxicity", "toxic", (4, 2))])
def test_held_out_rows_are_judged_well(spark, name, label, held):
    got = QUERIES[name](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(read_table(spark, SF, "labels"), "doc_id").withColumn("want", crc_remainder("doc_id", held[0]) == held[1])
    rows = rows.collect()
    assert all(r.held_out == r.want and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(r[label], r.predicted) for r in rows if r.held_out]
    assert np.mean([a == b for a, b in judged]) > 0.9


def test_held_out_labels_do_not_reach_the_fit(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    allowed = crc_remainder("doc_id", 5) != 0
    turned = labels.withColumn("quality", F.when(allowed, F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = gam.train(docs, labels, allowed), gam.train(docs, turned, allowed)
    assert one.intercept == two.intercept and all((a == b).all() for a, b in zip(one.tables, two.tables))


def test_odd_rows_are_scored(spark):
    model = gam.Gam(0.0)
    got = gam.score(documents(spark, ODD_TEXTS), model).collect()
    assert len(got) == len(ODD_TEXTS) and sum(r.doc_id is None for r in got) == 2
    kept = gam.score(documents(spark, ODD_TEXTS, extra=False).withColumn("score", F.lit("mine")), model, keep="_s")
    assert kept.columns == ["doc_id", "text", "score", "_s"] and {r.score for r in kept.collect()} == {"mine"}


def test_folding_and_exceptions():
    assert toxicity.fold("1D1OT, іdiоt ｉｄｉｏｔ $tupid!") == ["idiot", "idiot", "idiot", "stupid"]
    automaton = toxicity.Lexicon({"idiot": 4.0, "loser": 3.0, "trash": 2.0}, {"idio": 1.0}).automaton()
    weight, words, hits = toxicity.matched("an 1d10t and a 1oser, idiotic", automaton)
    assert (weight, words) == (8.0, 6) and len(hits) == 3
    assert toxicity.matched("idiot proof trash can", automaton)[0] == 0
    assert toxicity.matched("", automaton)[:2] == (0, 0) and toxicity.matched("midiot", automaton)[0] == 0


@pytest.mark.parametrize(
    "text",
    [
        "\u0131d\u0131ot", "\u00efdi\u00f6t", "i\u0307di\u0323ot", "idi\u00adot", "i\u200bdi\u200cot", "\ufeffidiot", "\u017ftupid",
        "i\u0111i\u00f8t", "\u0130D\u0130OT", "\u026a\u1d05\u026a\u1d0f\u1d1b", "\u0456di\u043e\u0301t", "\u201cidiot\u201d", "you idiot\u2014go",
    ],
)
def test_disguised_words_match(text):
    automaton = toxicity.Lexicon(dict(toxicity.KNOWN)).automaton()
    assert len(toxicity.matched(f"what an {text} here", automaton)[2]) == 1
    assert toxicity.fold("na\u00efve stra\u00dfe \u65e5\u672c\u8a9e") == ["naive", "strasse", "\u65e5\u672c\u8a9e"]


def test_longer_texts_dilute_matches(spark):
    rows = [(1, "idiot"), (2, "idiot " + "word " * 500), (3, "word " * 500)]
    scores = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), toxicity.Lexicon(dict(toxicity.KNOWN))).collect()}
    assert scores[1] > scores[2] > scores[3]


def test_exception_phrases_are_walked_once():
    """The same hits as trying every phrase, also nested and neighbouring ones; 100,000 phrases in one text."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        best = {int(a): (int(a + rng.integers(1, 6)), 1.0) for a in rng.integers(0, 60, 12)}
        harmless = [(int(a), int(a + rng.integers(1, 15))) for a in rng.integers(0, 60, 6)]
        want = [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in harmless)]
        assert toxicity._outside(best, sorted(harmless)) == want
    automaton = toxicity.Lexicon({"idiot": 2.0, "stupid": 3.0}).automaton()
    weight, words, hits = toxicity.matched("idiot stupid mistake " * 100_000, automaton)
    assert words == 300_000 and len(hits) == 100_000 and weight == 200_000.0
