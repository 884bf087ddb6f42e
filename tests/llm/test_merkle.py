"""Merkle manifest against a recursion in plain Python, and odd tables."""

import hashlib
import zlib

import pytest
from llm_tables import clashing, documents, empty, frame, odd  # noqa: F401
from pyspark.sql import functions as F

from jobsift.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(part, (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """(root, per node its steps)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            steps[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fanout])))
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], steps


def brute(rows, fanout=2):
    rows = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[g])], fanout) for g in names]
    root, over = climb([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, steps), above in zip(names, trees, over, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g]), steps, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(*r[:4], r[4] + 1) if hit else own
            for left, right in path + above:
                acc = h(left, acc, right)
            out.append((r[0], own, subroot, root, h(*[x for s in path + above for x in s]), acc, acc == root))
    return sorted(out, key=str)


def run(df, **how):
    found = merkle.verify(merkle.manifest(df, {"tampered": merkle.tampered()}, **how))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")), "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_supplied_documents(spark, documents):  # noqa: F811
    rows = [(i, t, la, s) for i, t, la, s in documents]
    found = run(frame(spark, rows))
    assert found == brute(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 4  # tampering shows, and nothing else does


@pytest.mark.parametrize("fanout,block", [(2, 8), (3, 9)])
def test_several_rounds_and_fanouts(spark, documents, fanout, block):  # noqa: F811
    rows = documents[:40]
    assert run(frame(spark, rows), fanout=fanout, block=block) == brute(rows, fanout)


def test_odd_tables(spark, odd, empty):  # noqa: F811
    from llm_tables import odd_rows

    assert run(odd) == brute(odd_rows())
    assert run(empty) == []
    one = [(7, "alone", "en", "a")]
    (row,) = run(frame(spark, one))
    assert row[1] == row[2] == row[3] and row[4] == h()
    assert run(clashing(frame(spark, one))) == [row]


def test_rows_alike_and_without_id_are_spread(spark):
    rows = [(None, "same", "en", "a")] * 40 + [(3, f"t{i % 2}", None, None) for i in range(9)] + [(i, "x", "é" if i % 2 else "z", "a") for i in range(5)]
    assert run(frame(spark, rows), block=8) == brute(rows)


def test_no_task_holds_a_group(spark):
    """All levels of a round run behind one exchange by block."""
    nodes = spark.range(64).select((F.col("id") % 3).alias("g"), F.col("id").alias("pos"), F.lit(64).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.struct("id").alias("m"))
    cur = nodes.select("g", F.expr("pos div 8").alias("block"), "pos", "n", "digest", F.array(F.struct("m", F.array().cast(merkle._STEPS).alias("steps"))).alias("members"))
    cur = cur.repartition("g", "block")
    for _ in range(3):
        cur = merkle._pivot(cur, 2)
    plan = cur._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
