"""Operator 9 — SimHash near-duplicates through BK-trees.

Fingerprints are 64-bit SimHashes over word shingles.  Distinct fingerprints
are sharded: two of them within ``radius`` bits agree on at least one of
``radius + 1`` blocks of bits, so a shard holds the fingerprints with one value
of one block, and every link lies inside a shard.  A shard's fingerprints form
a BK-tree (children keyed by their Hamming distance to the parent); each of
them is looked up in it, following only edges within the radius.  What leaves
a task is a spanning forest of its links, never all pairs; a distributed
union-find joins the forests of all shards.

The trees are not broadcast: together they are as large as the table of
fingerprints, which has no size bound.  Instead the few fingerprints that can
match a tree are sent to its task.  A shard of more than ``SHARD_ROWS`` is cut
again by the blocks of its remaining bits, which loses no link by the same
argument.  Documents with equal fingerprints are one node, combined map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, utf8
from .components import components

#: Words of a shingle, seed of XXH64, and bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a shard beyond which it is cut again.
SHARD_ROWS = 50_000
#: (query, node) pairs that a tree search holds at once.
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of the text's word shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - k + 1].tolist()
    h64 = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 16
    ends = ends[k - 1 :].tolist()
    for i in range(0, len(starts), step):
        hashes = [h64(joined[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed BIGINT; null counts as empty."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(x, shingle, seed) for x in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run(utf8(text))


# ---- BK-trees over all shards of a batch at once -------------------------------------

def build_trees(prints: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of distinct fingerprints, one tree per shard (rows sorted by shard).

    Returns each row's root, and the child table: keys ``parent * 65 +
    distance`` in ascending order with the child's row.  All rows not yet
    placed go down one edge per pass; where an edge is free, the first of the
    rows at it becomes the child.
    """
    n = len(prints)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
    root = np.repeat(first, np.diff(np.r_[first, n]))
    at, rows = root.copy(), np.flatnonzero(root != np.arange(n))
    keys, children = [], []
    while rows.size:
        edge = at[rows] * 65 + np.bitwise_count(prints[rows] ^ prints[at[rows]])
        key, pick, back = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(key)
        children.append(rows[pick])
        down = rows[pick][back]
        rest = down != rows
        at[rows] = down
        rows = rows[rest]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    return root, key[order], child[order]


def link_labels(prints: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the smallest row it is linked with, directly or not, inside its shard."""
    n = len(prints)
    root, key, child = build_trees(prints, shard)
    label = np.arange(n)
    todo = [(np.arange(i, min(i + FRONTIER, n)), root[i : i + FRONTIER]) for i in range(0, n, FRONTIER)]
    while todo:
        query, node = todo.pop()
        distance = np.bitwise_count(prints[query] ^ prints[node]).astype(np.int64)
        near = (distance <= radius) & (query > node)
        _unite(label, query[near], node[near])
        low = np.searchsorted(key, node * 65 + np.maximum(distance - radius, 0), "left")
        count = np.searchsorted(key, node * 65 + np.minimum(distance + radius, 64), "right") - low
        total = np.cumsum(count)
        cuts = [0, *np.unique(np.searchsorted(total, np.arange(FRONTIER, total[-1], FRONTIER))).tolist(), len(query)] if len(query) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            c = count[a:b]
            if c.sum():
                ahead = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[a:b], c)
                todo.append((np.repeat(query[a:b], c), child[ahead]))
    return label


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find on arrays: hook larger labels below smaller ones, halve paths, repeat."""
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forests(radius: int):
    """mapInArrow function: sorted (shard, fp) rows to links (fp, smaller fp) of a spanning forest."""

    def links(prints: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        label = link_labels(prints.view(np.uint64), shard, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[label[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, prints, rows = [], [], 0
        for batch in batches:
            shards.append(batch.column("shard").to_numpy(zero_copy_only=False))
            prints.append(batch.column("fp").to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= 4 * SHARD_ROWS:  # whole shards only; the last may go on in the next batch
                s, p = np.concatenate(shards), np.concatenate(prints)
                cut = int(np.searchsorted(s, s[-1], "left"))
                if cut:
                    yield links(p[:cut], s[:cut])
                shards, prints, rows = [s[cut:]], [p[cut:]], len(s) - cut
        if rows:
            yield links(np.concatenate(prints), np.concatenate(shards))

    return run


def shards(prints: DataFrame, kept: Staged, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, fp): each distinct fingerprint under every block value it has."""
    n = radius + 1
    width = 64 // n
    first = prints.select("fp", F.posexplode(F.array(*[
        F.shiftrightunsigned("fp", width * i).bitwiseAND(_mask(width if i < n - 1 else 64 - width * i)) for i in range(n)
    ])).alias("i", "v"))
    rows = first.select("fp", "i", (F.col("v") * n + F.col("i")).alias("shard"))
    large = kept.keep(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select("shard"), "large")
    if large.isEmpty():
        return rows.select("shard", "fp")
    rows = kept.keep(rows, "shards")
    # the bits outside block i, again in radius + 1 blocks; the hash names (shard, block, value)
    rest = F.expr(" ".join(
        ["CASE i"] + [f"WHEN {i} THEN {_without(i, n, width)}" for i in range(n)] + ["END"]
    ))
    sub = (64 - width + n - 1) // n
    inside = rows.join(large, "shard").withColumn("rest", rest).select("fp", "shard", F.posexplode(F.array(*[
        F.shiftrightunsigned("rest", sub * j).bitwiseAND(_mask(sub)) for j in range(n)
    ])).alias("j", "v"))
    small = rows.join(large, "shard", "left_anti").select("shard", "fp")
    return small.union(inside.select(F.xxhash64("shard", "j", "v").bitwiseOR(F.lit(-(1 << 63))).alias("shard"), "fp"))


def _mask(width: int) -> int:
    return -1 if width >= 64 else (1 << width) - 1


def _without(i: int, n: int, width: int) -> str:
    """SQL for fp without its block i."""
    low = f"(fp & {_mask(width * i)})" if i else "0L"
    above = width * (i + 1)
    return low if i == n - 1 else f"({low} | shiftleft(shiftrightunsigned(fp, {above}), {width * i}))"


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``radius``
    differing bits reach.  A text without words (null, empty, white space) has
    fingerprint 0, linked like any other.  Rows that repeat a doc_id keep their
    own fingerprints; a null doc_id counts for links but never as smallest id,
    unless its component has no other.  An empty table gives an empty table;
    further columns are not read.
    """
    kept = Staged(docs.sparkSession, "simhash")
    prints = kept.keep(docs.select("doc_id", fingerprint_column("text", shingle, seed).alias("fp")), "prints")
    nodes = kept.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = shards(nodes.select("fp"), kept, radius, shard_rows).repartition("shard").sortWithinPartitions("shard", "fp")
    parts = parts.select(F.col("shard"), F.col("fp"))
    linked = components(parts.mapInArrow(_forests(radius), "a BIGINT, b BIGINT"), kept)
    linked = kept.keep(linked.join(nodes, linked["node"] == nodes["fp"]).select("node", "root", "least"), "linked")
    roots = kept.keep(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = kept.keep(linked.join(roots, "root").select(F.col("node"), "component_id"), "named")
    nodes = kept.keep(nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return prints.join(nodes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest one; columns as they are.

    A row without doc_id can't be told from another one and stays.  Rows that
    repeat a doc_id stay together if that id is the smallest of its component
    for one of them.
    """
    found = near_duplicates(docs, **options)
    kept = Staged(docs.sparkSession, "simhash")
    drop = kept.keep(
        found.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")).where("stays = 0").select(F.col("doc_id").alias("_dropped")),
        "drop",
    )
    return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")
