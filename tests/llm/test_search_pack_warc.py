"""Exact search, packing, revisits and the pipeline."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, shingles
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import packing, va_search, warc_revisits
from seriesloom.llm.common import read_table
from seriesloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_results_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "pages", "documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def plain_top(rows, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for n, (q, x) in enumerate(usable):
        if q % 20 == 0:
            others = [(i, v) for m, (i, v) in enumerate(usable) if m != n and len(v) == len(x)]
            scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in others)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, k):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "'x' as v", "2 as dim", "0 as score")
    return va_search.top_k(va_search.prepare(made, 64), F.col("id") % 20 == 0, k)


def test_search_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(va_search, "BLOCK", 90)
    monkeypatch.setattr(va_search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=12)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(400, None), (420, [None] * 12), (440, [float("nan")] * 12), (460, [float("inf")] * 12), (480, []), (None, rows[0][1])]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 1.0])]
    assert sorted(map(tuple, search(spark, rows, 5).collect())) == plain_top(rows, 5)


def test_search_can_be_counted_and_projected(spark):
    rows = [(i, [1.0 + i % 7, 2.0 - i % 5]) for i in range(41)] + [(60, [1.0])]
    found, want = search(spark, rows, 5), plain_top(rows, 5)
    assert found.count() == len(want) == 15
    for column in found.columns:
        at = found.columns.index(column)
        assert sorted(r[0] for r in found.select(column).collect()) == sorted(r[at] for r in want)


def test_repeated_rows_are_candidates_of_each_other(spark, monkeypatch):
    """Queries and candidates repeated, under one id and under several, within and across blocks."""
    monkeypatch.setattr(va_search, "BLOCK", 10)
    monkeypatch.setattr(va_search, "QUERY_BLOCK", 3)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (7, [5.0, 5.0]), (7, [5.0, 5.0]), (7, [4.0, 4.0]), (8, [5.0, 5.0])]
    rows += [(20, [2.0, 2.0])] * 4 + [(i, [0.5, i / 9]) for i in range(21, 50)]
    for k in (3, 5, 100):
        assert sorted(map(tuple, search(spark, rows, k).collect())) == plain_top(rows, k)


def test_large_vectors_keep_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(va_search, "BLOCK", 40)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [float(np.float32(v * 3e6)) for v in rng.normal(size=6)]) for i in range(12)]
    rows += [(220, [2.0**24, 1.0, 0.0, 0.0, 0.0, 0.0]), (221, [2.0**24, 1.0, 0.0, 0.0, 0.0, 0.0]), (222, [2.0**24, 1.015625, 0.0, 0.0, 0.0, 0.0])]
    got = sorted(map(tuple, search(spark, rows, 6).collect()))
    assert got == plain_top(rows, 6) and max(s for *_, s in got) > 1 << 56


def test_search_with_few_or_no_rows(spark):
    assert sorted(map(tuple, search(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])], 20).collect())) == [(0, 1, 1, 8192), (0, 2, 2, -4096)]
    assert search(spark, [], 20).count() == 0
    with pytest.raises(PythonException, match="too large"):
        search(spark, [(0, [1e30]), (1, [1e30])], 2).collect()


def test_most_vectors_are_not_read_exactly(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(2000, 8)))
    read = []
    plain = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: read.append(1) or plain(keys))
    va_search.search_block(np.array([-1]), x[:1], np.arange(2000), np.arange(2000), x, 10)
    assert 1 <= len(read) <= 10


def test_packing_places_every_token_once(spark):
    rng = random.Random(2)
    lengths = [(i, rng.choice([0, 1, 5, 100, 511, 512, 513, 3000, 4096, 4097, 20_000, None])) for i in range(400)]
    lengths += [(1, 77), (None, 9), (None, None)]
    docs = spark.createDataFrame(lengths, "doc_id long, words long").selectExpr("*", "'x' as bin", "1 as shard", "2 as n", "3 as id")
    rows = packing.pack_documents(docs, F.col("words")).collect()
    tokens, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.length
        bins[r.bin].append((r.bin_offset, r.length, r.capacity))
    want = defaultdict(int)
    for i, n in lengths:
        want[i] += n or 0
    assert tokens == want and len(rows) == sum(max(1, -(-(n or 0) // 4096)) for _, n in lengths)
    for held in bins.values():
        held.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:])) and held[0][0] == 0
        filled, capacity = held[-1][0] + held[-1][1], held[0][2]
        assert filled <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= filled)
    assert packing.pack_documents(docs.limit(0), F.col("words")).count() == 0


def test_null_and_repeated_ids_spread_over_shards(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN -1 END AS doc_id", "CASE WHEN id % 3 = 0 THEN id % 700 ELSE 7 END AS words")
    packed = packing.pack_documents(rows, F.col("words")).withColumn("shard", F.split("bin", "-")[0]).persist()
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 1.5 * packing.SHARD
    counts = {r.doc_id: r["count"] for r in packed.filter("doc_id is null or doc_id = -1").groupBy("doc_id").count().collect()}
    assert counts == {None: 10_000, -1: 10_000}
    held = packed.groupBy("bin").agg(F.sum("length").alias("s"), F.max(F.col("bin_offset") + F.col("length")).alias("e"), F.max("capacity").alias("c"))
    assert held.filter("s <> e or s > c").count() == 0
    packed.unpersist()


def test_best_fit_and_downsizing():
    bins, offsets, sizes = packing.pack([3000, 1000, 1096, 600], (512, 1024, 2048, 4096))
    assert bins[0] == bins[2] and offsets[2] == 3000  # the tightest room, not the first
    assert sizes == [4096, 1024, 1024] and packing.pack([], (8,)) == ([], [], [])
    assert packing.pack([10], (16, 64))[2] == [16]
    lengths = [random.Random(i).randint(1, 900) for i in range(2000)]
    assert sum(lengths) / sum(packing.pack(lengths)[2]) > 0.99


def records(spark, rows):
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>"
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as canonical_url", "1 as response", "2 as slice", "'r' as reason")


def test_revisits(spark):
    u = "http://A.example/x?b=2&a=1"
    rows = [
        (1, u, 10, "response", {"ETag": "t1", "Content-Type": "text/html", "X": "old"}),
        (2, "https://www.a.example:443/x/?a=1&utm_source=f&b=2#top", 20, "revisit", {"etag": 'W/t1', "X": "new", "content-type": "no"}),
        (3, u, 30, "response", {"ETag": "t2", "Last-Modified": "d"}),
        (4, u, 40, "revisit", {"ETag": "t1"}),
        (5, u, 40, "revisit", {"Last-Modified": "d"}),
        (6, u, 40, "revisit", {}),
        (7, u, 5, "revisit", {"ETag": "t1"}),
        (8, u, 30, "revisit", {"ETag": "t2"}),
        (0, u, 30, "revisit", {"ETag": "t1"}),
        (9, None, 50, "revisit", None),
        (10, u, None, "revisit", {"ETag": "t2"}),
        (11, u, 60, "other", {"ETag": "t2"}),
        (None, u, 60, "revisit", None),
        (12, u, 70, None, None),
        (13, None, 1, "response", None),
        (14, u, 80, "revisit", {"ETag": "x", "etag": "t2"}),
    ]
    got = {r.record_id: r for r in warc_revisits.resolve_revisits(records(spark, rows)).collect()}
    assert {k: (r.response_id, r.reason) for k, r in got.items()} == {
        2: (1, "resolved"), 4: (None, "validator differs"), 5: (3, "resolved"), 6: (None, "no validator"),
        7: (None, "no earlier response"), 8: (3, "resolved"), 0: (1, "resolved"), 9: (None, "incomplete record"),
        10: (None, "incomplete record"), None: (None, "incomplete record"), 14: (3, "resolved"),
    }
    assert got[2].headers == {"etag": "W/t1", "x": "new", "content-type": "text/html"}
    assert warc_revisits.resolve_revisits(records(spark, [])).count() == 0


def test_a_hot_url_is_spread_and_right(spark):
    rng = random.Random(4)
    rows = [(i, "http://h/a", rng.randrange(3000), rng.choice(["response", "revisit", "revisit"]), {"ETag": "t"}) for i in range(3000)]
    got = {r.record_id: r.response_id for r in warc_revisits.resolve_revisits(records(spark, rows)).collect()}
    latest = None
    for ts, i, kind in sorted((r[2], r[0], r[3]) for r in rows):
        if kind == "response":
            latest = i
        else:
            assert got[i] == latest


def test_pipeline_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = made[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in made.items()}
    assert set(ids["toxicity"]) <= set(ids["quality"]) <= set(before)
    sets = {i: shingles(before[i]) for i in ids["near_duplicates"]}
    assert all(100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a])
    assert sorted(ids["secrets"]) == sorted(ids["near_duplicates"]) == sorted(set(ids["packing"]))
    assert all(r.n_chars == len(r.text) and "token = \"" not in r.text for r in made["secrets"].collect())


def test_pipeline_on_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, extra=False).selectExpr("*", "cast(null as string) lang", "'s' as source", "0L as n_chars")
    left = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id) == sorted({(i, t) for i, t in ODD_TEXTS if i}, key=lambda r: r[0])
    assert sum(r.doc_id is None for r in left) == 2
    assert corpus_pipeline.secrets(spark, docs, SF).count() == len(ODD_TEXTS)
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, SF).collect()} == {i for i, _ in ODD_TEXTS}
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
