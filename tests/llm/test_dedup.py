"""Near-duplicate documents and vectors against comparing all pairs."""

import random

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, shingles, smallest_reachable

from seriesloom.llm import fast_minhash, rabitq
from seriesloom.llm.components import components
from seriesloom.llm.shingles import shingle_sets


def check(spark, rows):
    got = fast_minhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(text))
    links = [
        (a, b) for a in sets for b in sets if a < b
        for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    least = smallest_reachable(sets, links)
    want = [(i, len(shingles(t)), least.get(i), i is None or least[i] == i) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return links


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_documents_like_all_pairs(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 200))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, edited(rng, base[i % 40], rng.randint(0, 4)).upper()) for i in range(120)]
    rows += [(500 + i, " ".join(base[1])) for i in range(60)]
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(700 + i, shared + " " + edited(rng, base[5], 40)) for i in range(40)]
    links = check(spark, rows + ODD_TEXTS)
    assert len(links) > 1000


def test_chains_of_links_are_one_component(spark):
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(11)]
    assert len(check(spark, rows)) == 10


def test_no_documents(spark):
    assert fast_minhash.near_duplicates(documents(spark, [])).count() == 0
    check(spark, [(None, "a b c"), (None, None)])
    check(spark, [(1, ""), (2, " "), (3, None)])


def test_sets_are_those_of_the_words():
    texts = ["", "a", "A b", "a b c d e", "a b c d e f a b c d e", "É é\x0b日 x y z q", "ab c", "a bc"]
    for text, made in zip(texts, shingle_sets(texts)):
        assert len(made) == len(shingles(text)) and (np.diff(made.astype(object)) > 0).all()
    sets = [s.tobytes() for s in shingle_sets(texts)]
    assert len(set(sets)) == len(sets) and shingle_sets(["a B"])[0] == shingle_sets(["A b"])[0]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    for size in (1, 3, 50, 3000):
        common = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        other = rng.integers(1, 1 << 63, max(1, size // 3), dtype=np.uint64)
        made = fast_minhash.sketches([np.unique(common), np.unique(np.concatenate([common, other]))])
        assert (made != fast_minhash._EMPTY).all()
        true = size / (size + len(other))
        assert abs((made[0] == made[1]).mean() - true) < 0.2
    assert (fast_minhash.sketches([np.zeros(0, np.uint64)]) == fast_minhash._EMPTY).all()


def test_components_of_random_links(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3), (4, None)]
    links += [(400 + i, 401 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == smallest_reachable({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return made.selectExpr("*", "cast(null as string) node", "1 as n", "2.5 as v", "'x' as unit", "7 as copies")


def test_vectors_like_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        centre = rng.normal(size=24)
        for j in range(25):
            x = centre + rng.normal(size=24) * rng.uniform(0, 0.5)
            rows.append((len(rows), [float(v) for v in np.float32(x * rng.uniform(0.1, 9))], int(j % 7 == 0)))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(50)]
    odd = [
        (2000, None, 1), (2001, rows[0][1], None), (2002, [0.0] * 24, 0), (2003, [float("nan")] + [1.0] * 23, 0),
        (2004, [None] + [1.0] * 23, 0), (2005, [float("inf")] + [1.0] * 23, 0), (2006, [], 0), (2007, [1.0, 2.0], 0),
        (None, rows[0][1], 0), (2008, [2.0, 4.0], 0),
    ]
    got = {r.vec_id: r for r in rabitq.near_vectors(vectors(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    least = smallest_reachable(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(near)))])
    found = sum(got[i].n_links for i in ids.tolist())
    assert near.sum() > 2000 and 0.99 * near.sum() <= found <= near.sum()
    assert np.mean([got[i].component_id == least[i] for i in ids.tolist()]) > 0.99
    assert (got[2007].n_links, got[2008].component_id) == (1, 2007)
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, [float(v) for v in centre + rng.normal(size=16) * 0.02], 1) for i in range(600)]
    monkeypatch.setattr(rabitq, "BLOCK", 100)
    got = rabitq.near_vectors(vectors(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}


def test_no_vectors(spark):
    assert rabitq.near_vectors(vectors(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(400, 1)
    exact = np.einsum("nd,nd->n", x[i], x[j]) >= 0.93
    assert exact.sum() > 20 and (rabitq.close_pairs(x, i, j, 0.93) == exact).all()
    errors = []
    for turn in rabitq.rotations(64, 40):
        t = x @ turn.T
        code = np.where(t > 0, 1, -1) / 8
        errors.append((code[0] @ t[200]) / (code[0] @ t[0]) - x[0] @ x[200])
    assert abs(np.mean(errors)) < 0.05


@pytest.mark.parametrize("largest", [1, 1000, 10**6, 10**9])
def test_tables_keep_the_recall_at_every_size(largest):
    bits, tables = rabitq.plan(largest, 0.93)
    meet = (1 - np.arccos(0.93) / np.pi) ** bits
    assert 1 - (1 - meet) ** tables >= 0.999 and largest / 2**bits <= 2


def test_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(12)
    base = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(200) < rng.uniform(0.75, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 63, 8, dtype=np.uint64)])))
    own = [int(c) for c in rng.integers(0, 40, 60)]
    marks = fast_minhash.sketches(sets).astype(np.uint8)
    found = fast_minhash.block_links(own, marks, sets)
    plain = [(i, j) for i in range(60) for j in range(i) if fast_minhash.linked(sets[i], sets[j])]
    assert len(plain) > 100 and all(fast_minhash.linked(sets[i], sets[j]) for i, j in found)
    same = [(i, j) for i in range(60) for j in range(i) if own[i] == own[j]]
    assert smallest_reachable(range(60), same + found) == smallest_reachable(range(60), same + plain)
    assert len(found) < 60
