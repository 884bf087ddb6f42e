import re

import numpy as np
import pytest
import xxhash
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm import simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    """{(id, fp): smallest reachable id} by comparing all with all."""
    ids, prints = [i for i, _ in pairs], np.array([f for _, f in pairs], np.uint64)
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(pairs)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], int(prints[i]), least.get(find(i))) for i in range(len(pairs))), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.select("doc_id", "fp", "component_id").collect()), key=str)


@pytest.mark.parametrize("shard_rows", [50_000, 3])
def test_documents(spark, documents, shard_rows):
    want = brute_components([(i, brute_print(x)) for i, x, *_ in documents])
    assert found(simhash.near_duplicates(frame(spark, documents), shard_rows=shard_rows)) == want


def test_odd_table(odd):
    assert found(simhash.near_duplicates(odd)) == brute_components([(i, brute_print(x)) for i, x, *_ in odd_rows()])


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_trees_find_chains_and_dense_balls(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(30)]
    prints = np.unique(np.array(near, np.uint64))
    label = simhash.link_labels(prints, np.zeros(len(prints), np.int64))
    want = {f: c for _, f, c in brute_components(list(enumerate(prints.tolist())))}
    assert [int(x) for x in label] == [want[int(f)] for f in prints]


def test_keep_one_keeps_columns_and_smallest_ids(spark, documents):
    df = frame(spark, documents)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_components([(i, brute_print(x)) for i, x, *_ in documents])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
