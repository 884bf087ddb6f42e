import hashlib
import re

import pytest
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401

from jobsift.llm.exact import exact_dedup


def brute(rows):
    groups = {}
    for i, x, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x or ""), []).append(i)
    out = []
    for x, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(x.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_documents(spark, documents):
    assert found(exact_dedup(frame(spark, documents))) == brute(documents)


@pytest.mark.parametrize("bits", [64, 2])
def test_odd_table_with_many_blocks_and_forced_hash_collisions(odd, bits):
    assert found(exact_dedup(odd, block_chars=9973, hash_bits=bits)) == brute(odd_rows())


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
