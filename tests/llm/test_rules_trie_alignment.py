"""Rules on texts, the trie of conversations and the alignment of two tokenizers, against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents

from seriesloom.llm import prefix_trie, quality_rules, token_alignment
from seriesloom.llm.queries import BYTE_LEVEL, PIECES


def plain_counts(text):
    """The measures that the contract names, counted word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    under = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


def test_measures_like_counting(spark):
    passage = "a b c d e f g h i"
    texts = [
        passage, f"{passage} x {passage}", f"{passage}\n{passage}\n{passage}", "x " * 40, "one $ two * | <b> # 100%",
        "a\x0bb\x0cc\rd\te f\x85g h  i", "l1\n\nl1\n \nl1\nl1 ", "🙂 é" * 9, " lead and trail ", "A B c d e f g h A B c d e f g",
    ]
    rows = [*ODD_TEXTS[:4], *ODD_TEXTS[5:], *((100 + i, t) for i, t in enumerate(texts))]
    got = quality_rules.judge(documents(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == sorted((str(i), *plain_counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.broken_rules == "")


def test_long_texts_and_no_texts(spark):
    rows = [(1, "ab " * 300_000), (2, " ".join(f"w{i}" for i in range(200_000)))]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert got[1].n_repeat_words == 300_000 and got[2].n_repeat_words == 0 and not got[1].kept
    assert quality_rules.judge(documents(spark, [])).count() == 0


def test_a_table_of_rules_decides(spark):
    good = "The house of the man is on the hill and it was built with stones. " + " ".join(f"word{'abcdefghij'[i % 10]}{i}" for i in range(30))
    rows = [(1, good), (2, good.upper()), (3, good.replace(" ", " | ")), (4, "\n".join(f"- {w} {w}x the" for w in good.split()))]
    got = {r.doc_id: r.broken_rules for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert got[1] == "" and "capitals" in got[2] and "symbols" in got[3] and "bullets" in got[4]
    own = quality_rules.judge(documents(spark, rows), [quality_rules.Rule("short", "n_words", most=5)], [])
    assert {r.broken_rules for r in own.collect()} == {"short"} and not any(r.base_failed for r in own.collect())


def plain_alignment(texts):
    """Measures of every text by enumerating all links."""
    e = token_alignment.Encoders(BYTE_LEVEL, PIECES)
    rows, holds = [], Counter()
    for text in texts:
        text = text or ""
        a = e.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = e.b.encode(text) if text else []
        spans = []
        for ids, size in ((a, e.a_bytes), (b, e.b_bytes)):
            ends = list(itertools.accumulate(len(size[i]) for i in ids))
            spans.append(list(zip(ids, ends)))
        joined = [b"".join(size[i] for i in ids) for ids, size in ((a, e.a_bytes), (b, e.b_bytes))]
        if not text or any(j != (" " + text).encode() for j in joined):
            rows.append((0, 0, 0, [], ""))
            continue
        cuts = sorted({x for _, x in spans[0]} & {x for _, x in spans[1]})
        parts = [[[i for i, end in side if low < end <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
        found = [(x, y) for p in parts for x in p[0] for y in p[1]]
        holds.update(set(found))
        shown = ";".join("|".join(",".join(map(str, side)) for side in p) for p in parts)
        rows.append((len(a), len(b), len(cuts), found, hashlib.sha256(shown.encode()).hexdigest()))
    best = {}
    for (x, _), n in holds.items():
        best[x] = max(best.get(x, 0), n)
    return [(n, m, g, len(f), sum(holds[p] == best[p[0]] for p in f), sum(holds[p] for p in f), h) for n, m, g, f, h in rows]


ALIGNED = [
    "The quick brown fox", "The quick brown fox", "the fox", "\n\n  two  spaces\t", "日本語のテキスト 🙂 é", "a▁b", "<|endoftext|> <s> </s>",
    "İstanbul ß ﬁ ​", "xxxxxxxxxxxxxxxxxxxxxxx" * 9, " lead", "trail ", "\x00 nul", "é combined", "antidisestablishmentarianism " * 3,
]


@pytest.mark.parametrize("share, hot, small", [(1 << 18, 10_000, 64), (3, 2, 1), (0, 0, 2)])
def test_alignment_like_all_links(spark, monkeypatch, share, hot, small):
    """With no room for common pairs and texts everything is joined by shuffles, with the same result."""
    monkeypatch.setattr(token_alignment, "SHARE", share)
    monkeypatch.setattr(token_alignment, "HOT_TEXTS", hot)
    rows = [(i, t) for i, t in enumerate(ALIGNED)] + [r for r in ODD_TEXTS if r[1] is None or len(r[1]) < 100]
    got = token_alignment.align(documents(spark, rows), BYTE_LEVEL, PIECES).collect()
    want = [(i, *w) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_large_groups_are_laid_out_by_distinct_tokens():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 50)
    in_a, in_b = np.sort(rng.integers(0, 3, 60)), np.sort(rng.integers(0, 3, 50))
    want = Counter(int(x) * token_alignment.WIDTH + int(y) for x, g in zip(a, in_a) for y, h in zip(b, in_b) if g == h)
    codes, times = token_alignment.links(a, b, in_a, in_b, 3)
    assert dict(zip(codes.tolist(), times.tolist())) == dict(want)


def test_long_texts_are_cut_without_changing_tokens(monkeypatch):
    e = token_alignment.Encoders(BYTE_LEVEL, PIECES)
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "a", "the", "it's", "1984", "é", "日本", "!?", " \t", "x "]
    texts = ["".join(rng.choice(pieces) for _ in range(400)) for _ in range(30)] + ["", " ", "no", "nospace" * 50]
    whole = e.ids(texts)
    monkeypatch.setattr(token_alignment, "LONG", 10)
    monkeypatch.setattr(token_alignment, "PART", 7)
    assert max(len(e.parts(t)) for t in texts) > 10
    for (a, b), (c, d) in zip(whole, e.ids(texts)):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_nothing_to_align(spark):
    assert token_alignment.align(documents(spark, []), BYTE_LEVEL, PIECES).count() == 0
    got = token_alignment.align(documents(spark, [(1, None), (None, "")]), BYTE_LEVEL, PIECES).collect()
    assert sorted(str(tuple(r)) for r in got) == ["(1, 0, 0, 0, 0, 0, 0, '')", "(None, 0, 0, 0, 0, 0, 0, '')"]


def plain_trie(rows):
    """Nodes of the rebuilt conversations by enumerating prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h, start = zlib.crc32(str(c).encode()) % 9, int(math.fmod(c, 5))
        made[c] = own.get(c - start, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in under if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in under)
        out.append((min(who), len(path), parent, len(who), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return made.selectExpr("*", "cast(null as string) as key", "cast(null as int) as depth", "cast(null as long) as root", "'x' as parent")


def mixed_conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 90), n):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn % 4 == 0 else "user", rng.choice(["é", "bb", "ccc"]) if rng.random() < 0.3 else "same"))
    rows += [(200, t, "user", f"long {t}") for t in range(150)] + [(205, t, "user", f"long {t}") for t in range(150)]
    rows += [(c, t, "user", "copy") for c in range(300, 360, 5) for t in range(3)]
    rows += [(401, 0, "user", "no base"), (402, None, None, None), (402, None, "user", "x"), (402, 1, None, "y"), (None, 1, "user", "none"), (403, 0, "u", "")]
    rows += [(10, 1, "user", "twice"), (10, 1, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("top, parts", [(10_000, 8), (20, 40), (3, 7), (1, 1)])
def test_trie_like_enumeration(spark, monkeypatch, top, parts):
    """Whatever the size of the crown and wherever conversations are cut by partitions."""
    monkeypatch.setattr(prefix_trie, "TOP", top)
    rows = mixed_conversations(top)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.trie(conversations(spark, rows), prefix_trie.Borrowing()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rows)


def test_trie_of_plain_conversations_and_of_none(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c")]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(conversations(spark, rows)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 2)} and got[1, 1].n_leaves == 2 and got[1, 0].saved_tokens == 1
    assert prefix_trie.trie(conversations(spark, [])).count() == 0
    assert prefix_trie.trie(conversations(spark, [(None, 0, "u", "a")]), prefix_trie.Borrowing()).count() == 0


def test_queue_spills_and_stays_sorted():
    rng = random.Random(2)
    queue, items = prefix_trie.SpillingQueue(held=50), [(rng.randrange(10_000), bytes([i % 256])) for i in range(3000)]
    for item in items[:2000]:
        queue.push(item)
    assert len(queue.runs) > 10 and len(queue.heap) <= 50
    got = [queue.pop() for _ in range(500)]
    for item in items[2000:]:
        queue.push((item[0] + 10_000, item[1]))
    while queue.first() is not None:
        got.append(queue.pop())
    assert got == sorted([*items[:2000], *((a + 10_000, b) for a, b in items[2000:])])


def test_both_ways_to_merge_give_the_same_tokens():
    """Every token of the vocabulary, every early character in several places, and mixed texts."""
    e = token_alignment.Encoders(BYTE_LEVEL, PIECES)
    assert e.fast is not None
    early = [chr(c) for c in range(ord(token_alignment.EARLY)) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    texts = [t for t in (x.decode("utf-8", "ignore") for x in e.a_bytes) if t and max(t) < token_alignment.EARLY]
    texts += [shape.replace("_", c) for c in early for shape in (" _", "a_b", "1_ 2", " _ _\n_", "'_ll")]
    texts += ["".join(rng.choice(early[:200] + [" ", "\n", "'s"]) for _ in range(60)) for _ in range(3000)]
    slow = [x.ids for x in e.a.encode_batch_fast(texts, add_special_tokens=False)]
    assert [e.fast.encode_ordinary(t) for t in texts] == slow
