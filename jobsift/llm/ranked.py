"""Operator 12 — ranked lexical search with range-maximum tables.

One scan turns a document into its length and the occurrences of query terms,
and stores them.  From the stored rows come the collection's statistics and,
in bounded shards of documents in order of their id, posting lists with the
impact that each posting adds to a score.  Over the posting lists lies a sparse
table that gives the largest impact of any range in two look-ups.

A query is answered best first.  The bound of an interval of documents is the
sum, over the query's terms, of the list's maximum inside it.  The interval
with the largest bound is split at the document with the largest impact, which
is scored; what is left on both sides gets its own, smaller bounds.  Intervals
of a few hundred documents are scored outright.  The search ends when no
interval can hold a document better than the k-th one found.

Scale: postings are never exchanged.  A task takes its rows shard by shard and
returns k documents per query whatever it read; these are merged in two steps.
Queries are taken in blocks with a bounded number of terms, so that the term
list that travels with the tasks has a bound; the documents are scanned once
per block.  Scores and ties are exact: an interval is left out only if its
bound, or its first id at an equal bound, is beaten by k documents.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, utf8

#: Results per query; the weight of a document's length in percent.
TOP, LENGTH_WEIGHT = 10, 90
#: Bounds of a shard; documents that are scored outright; query terms of a block.
SHARD_DOCS, SHARD_POSTINGS, LEAF, BLOCK_TERMS = 8192, 1 << 20, 512, 1 << 18
#: Groups in which the tasks' results are merged first.
MERGE = 32
#: Bytes of a text that are cut into terms at once.
SEGMENT = 4 << 20

#: ASCII letters and digits and all bytes beyond ASCII make terms (A-Z as a-z), the rest parts them.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def term_counts(raw: bytes) -> Counter:
    """The occurrences of each term of a UTF-8 text."""
    raw, counts, at = raw.translate(_FOLD), Counter(), 0
    while len(raw) - at > SEGMENT:
        cut = raw.find(b" ", at + SEGMENT)
        cut = len(raw) if cut < 0 else cut
        counts.update(raw[at:cut].split())
        at = cut
    counts.update(raw[at:].split() if at else raw.split())
    return counts


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """The posting lists of some documents, in order of their ids (null last), with their range-maximum table.

    ``keys`` is term * documents + document, ``impact`` what the posting adds.
    """

    def __init__(self, ids: list, norms: list[int], sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        self.ids = [(ids[i] is None, ids[i]) for i in order]
        self.n = len(ids)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        doc = np.repeat(place, sizes)
        norm = np.repeat(np.array(norms, np.int64), sizes)
        key = terms.astype(np.int64) * self.n + doc
        by_key = np.argsort(key)
        self.keys = key[by_key]
        tf = tfs.astype(np.int64)
        self.impact = (weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm)))[by_key]
        self.starts = np.searchsorted(self.keys, np.arange(len(weights) + 1) * self.n)
        self._table(int(np.diff(self.starts).max(initial=0)))

    def _table(self, longest: int) -> None:
        """``best[j][i]`` is the place of the largest impact among the 2^j postings from i on, the first of equal ones."""
        self.best = [np.arange(len(self.impact), dtype=np.int32)]
        while 2 ** len(self.best) <= longest:
            half = 2 ** (len(self.best) - 1)
            a, b = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.log = np.zeros(longest + 1, np.int8)
        for j in range(1, len(self.best)):
            self.log[2**j :] = j

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The places of the largest impacts of the posting ranges [lo, hi), none of them empty."""
        level = self.log[hi - lo]
        out = np.empty(len(lo), np.int64)
        for j in set(level.tolist()):
            m = level == j
            a, b = self.best[j][lo[m]], self.best[j][hi[m] - 2**j]
            out[m] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out

    def search(self, terms: np.ndarray, found: list[tuple], k: int, leaf: int = LEAF) -> None:
        """Add this shard's documents to ``found``: up to ``k`` (-score, (no id, id)) in order, the best so far."""
        heap: list[tuple] = []

        def push(first: int, end: int, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            some = lo < hi
            if not some.any():
                return
            if not some.all():
                terms, lo, hi = terms[some], lo[some], hi[some]
            tops = self.maxima(lo, hi)
            bound = int(self.impact[tops].sum())
            if bound > 0 and (len(found) < k or (-bound, self.ids[first]) < found[-1]):
                heapq.heappush(heap, (-bound, first, end, terms, lo, hi, tops))

        def add(score: int, doc: int) -> None:
            if score > 0:
                insort(found, (-score, self.ids[doc]))
                del found[k:]

        push(0, self.n, terms, self.starts[terms], self.starts[terms + 1])
        while heap:
            bound, first, end, terms, lo, hi, tops = heapq.heappop(heap)
            if len(found) == k and (bound, self.ids[first]) >= found[-1]:
                return
            if end - first <= leaf:
                self._score_all(first, end, lo, hi, terms, found, k, add)
                continue
            t = int(self.impact[tops].argmax())
            doc = int(self.keys[tops[t]] - terms[t] * self.n)
            mid = np.searchsorted(self.keys, terms * self.n + doc)
            after = np.minimum(mid, len(self.keys) - 1)
            hit = (self.keys[after] == terms * self.n + doc) & (mid < hi)
            add(int(self.impact[after[hit]].sum()), doc)
            for a, b, from_, to in ((first, doc, lo, mid), (doc + 1, end, mid + hit, hi)):
                if 4 * (b - a) > 3 * (end - first):  # lists of equal impacts would give up one document at a time
                    half = (a + b) // 2
                    cut = np.searchsorted(self.keys, terms * self.n + half)
                    push(a, half, terms, from_, cut)
                    push(half, b, terms, cut, to)
                elif a < b:
                    push(a, b, terms, from_, to)

    def _score_all(self, first: int, end: int, lo: np.ndarray, hi: np.ndarray, terms: np.ndarray, found: list, k: int, add: Callable) -> None:
        places = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        docs = self.keys[places] - np.repeat(terms, hi - lo) * self.n - first
        score = np.zeros(end - first, np.int64)
        np.add.at(score, docs, self.impact[places])
        least = max(1, -found[-1][0]) if len(found) == k else 1
        good = np.flatnonzero(score >= least)
        for d in good[np.argsort(-score[good], kind="stable")[:k]].tolist():  # of equal ones those with the smallest ids
            add(int(score[d]), first + d)


def _count_rows(vocabulary: dict[bytes, int]):
    """mapInArrow function: (doc_id, raw) to (doc_id, n, terms, tfs) of documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, terms, tfs = [], [], [], []
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                counts = term_counts(raw)
                if counts:
                    keep.append(i)
                    n.append(counts.total())
                    known = counts.keys() & vocabulary.keys()
                    terms.append([vocabulary[t] for t in known])
                    tfs.append([counts[t] for t in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def _search_rows(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, bounds: tuple[int, int, int]):
    """mapInArrow function: stored rows to (q, part, doc_id, score), the best ``k`` per query of the whole partition."""
    shard_docs, shard_postings, leaf = bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = rows.column("terms").chunk(0)
            norms = [100 - LENGTH_WEIGHT + LENGTH_WEIGHT * n * n_docs // n_terms for n in rows.column("n").to_pylist()]
            shard = Shard(
                rows.column("doc_id").to_pylist(), norms, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(),
                rows.column("tfs").chunk(0).flatten().to_numpy(), weights,
            )
            for (_, terms), best in zip(queries, found, strict=True):
                shard.search(terms, best, k, leaf)

        docs = postings = 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                docs += part.num_rows
                postings += len(part.column("terms").flatten())
                if docs >= shard_docs or postings >= shard_postings:
                    flush()
                    docs = postings = 0
        flush()
        part = TaskContext.get().partitionId()
        out = [(q, part, doc, -score) for (q, _), best in zip(queries, found, strict=True) for score, (_, doc) in best]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), kind, pa.int64()], strict=True)], names=["q", "part", "doc_id", "score"]
        )

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(term_counts(raw)) for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS,
    bounds: tuple[int, int, int] = (SHARD_DOCS, SHARD_POSTINGS, LEAF),
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Null texts have no terms; an item without any, or none of whose terms
    occurs, has no rows.  Rows that repeat an item_id are answered one by one,
    rows that repeat a doc_id ranked one by one; of equal scores a null id comes
    last.  Empty tables give an empty table.  Further columns are not read.
    """
    kept = Staged(docs.sparkSession, "ranked")
    kind, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", utf8().alias("raw")).mapInArrow(_query_terms, f"item_id {item}, terms ARRAY<BINARY>")
    asked = kept.keep(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).where(F.size("terms") > 0).select("q", "terms").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for row in block for t in row.terms}))}
        queries = [(row.q, np.array([vocabulary[bytes(t)] for t in row.terms], np.int64)) for row in block]
        texts = docs.select("doc_id", utf8().alias("raw"))
        rows = kept.keep(texts.mapInArrow(_count_rows(vocabulary), f"doc_id {kind}, n BIGINT, terms ARRAY<INT>, tfs ARRAY<BIGINT>"), "postings")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        holding = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per query term of the block
        weights = np.array([weight(holding.get(i, 0), n_docs) for i in range(len(vocabulary))], np.int64)
        best = rows.mapInArrow(_search_rows(queries, weights, n_docs, n_terms, k, bounds), f"q BIGINT, part INT, doc_id {kind}, score BIGINT")
        best = kept.keep(_best(best.withColumn("part", F.pmod("part", F.lit(MERGE))), ["q", "part"], k).drop("part", "rank"), "best")
        kept.drop(rows)
        out = best if out is None else out.union(best)
    if out is None:
        return asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranked = _best(out, ["q"], k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
