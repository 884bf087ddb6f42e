"""Ranked search against scoring every document, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from llm_tables import clashing, documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=10):
    held = [(i, c) for i, c in ((d[0], terms(d[1])) for d in docs) if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    asked = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    docs = docs if hasattr(docs, "columns") else frame(spark, docs)
    return sorted((tuple(r) for r in ranked.search(docs, asked, **how).collect()), key=str)


def test_supplied_tables(spark, documents):  # noqa: F811
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    exact = brute(documents, items)
    assert run(spark, documents, items) == exact
    # small shards and leaves: many intervals, merged over tasks; several blocks of queries
    assert run(spark, frame(spark, documents).repartition(5), items, bounds=(16, 400, 2), block_terms=100) == exact


def test_copies_ties_and_common_words(spark):
    rng = random.Random(5)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [200, 100, 80] + [3] * 60, k=rng.randint(1, 30))), "en", "a") for i in range(400)]
    docs += [(1000 + i, "the same page again", "en", "a") for i in range(300)]
    rng.shuffle(docs)
    items = [(1, "the of and"), (2, "the same page"), (3, "w1 w2 w3 The THE"), (4, "nothing_known"), (5, ""), (6, None), (2, "the same page"), (7, "the")]
    for bounds in ((8192, 1 << 20, 512), (64, 1 << 20, 1), (701, 1 << 20, 8)):
        assert run(spark, docs, items, bounds=bounds) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_odd_tables(spark, odd, empty):  # noqa: F811
    items = [(1, "one two 日本語 é"), (None, "alpha ONE"), (3, "x" * 200_000), (4, "\x00 9 a\tñandú"), (5, "alpha " * 100_000)]
    assert run(spark, odd, items) == brute(odd_rows(), items)
    assert run(spark, empty, items) == [] and run(spark, odd, []) == []
    asked = clashing(spark.createDataFrame(items, "item_id BIGINT, text STRING"))
    assert ranked.search(odd, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT", 50)
    raw = ("Ünïcode and ascii-words, 42 " * 40).encode()
    assert ranked.term_counts(raw) == Counter({t.encode(): n for t, n in terms(raw.decode()).items()})
    assert ranked.term_counts(b"a" * 500) == {b"a" * 500: 1}


def test_range_maxima():
    rng = np.random.default_rng(1)
    n, v = 40, 3
    sizes = np.full(n, v)
    shard = ranked.Shard(list(range(n)), [100] * n, sizes, np.tile(np.arange(v), n), rng.integers(1, 9, n * v), np.array([5, 7, 11]))
    for t in range(v):
        lists = shard.impact[shard.starts[t] : shard.starts[t + 1]]
        for a in range(n):
            for b in range(a + 1, n + 1):
                place = shard.maxima(np.array([shard.starts[t] + a]), np.array([shard.starts[t] + b]))[0]
                assert shard.impact[place] == lists[a:b].max()


def test_most_intervals_are_left_out():
    """A few documents hold the query's rare words: the others are never scored."""
    n = 4096
    tf = np.ones(2 * n, np.int64)
    tf[0::2][[7, 900, 4000]] = 50
    shard = ranked.Shard(list(range(n)), [100] * n, np.full(n, 2), np.tile(np.arange(2), n), tf, np.array([4000, 1]))
    scored = []
    whole = shard._score_all
    shard._score_all = lambda first, end, *rest: (scored.append(end - first), whole(first, end, *rest))[1]
    found = []
    shard.search(np.array([0, 1]), found, 3, 64)
    assert [x[1][1] for x in found] == [7, 900, 4000] and sum(scored) < n / 4
