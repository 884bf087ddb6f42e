"""Operator 6 — fuzzy line deduplication by MinHash.

Lines with a word are compared without regard to case and white space.  Equal
lines are grouped by a 128-bit content hash first.  Different lines are
compared through character shingles: of five where both have fewer than 150
characters, so that one changed word or number leaves a short line similar, of
nine where both have 120 or more, so that long lines of one language don't
share most of theirs (``VIEWS``; lines of 120 to 149 are compared in both ways
and similar if either says so).  MinHash signatures of
``BANDS`` bands of ``ROWS`` values find candidates, exact Jaccard similarity of
the shingle sets decides, a distributed union-find joins what is similar, and
of each component the line that stands first (smallest doc_id, then row, then
line number) stays.  A row's number is stored with it once, so that rows without
id or with the same one are documents of their own.

Candidates without all pairs: in every band bucket each line is verified
against the bucket's smallest line only.  Where the components found so far
leave a bucket of three or more lines in several parts, the lines of different
parts are joined exactly, so no link is lost and a group of thousands of copies
costs thousands of comparisons.  Few such pairs are compared one by one.  A
bucket with many is dealt into blocks of a bounded number of shingles, of which
every two meet in a task.  A bucket of so many blocks that this would copy its
lines more often than a prefix filter does (``LISTED``) is first dealt into that
filter's lists, spread over the cluster: with shingles ordered by rarity, two
similar lines share one of their first n - ceil(0.8 n) + 1, so lines that have
only common shingles in common part ways.  A list is treated as a bucket was:
smallest line first, then few pairs, then blocks.

What moves: hashes of lines and bands; the texts of lines that share a band
with another line (a bitmap of fixed size tells the scan which these may be);
and the documents twice, when their rows are numbered and when they meet the
numbers of their dropped lines.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, batch_rows, free_name, text_or_empty
from .components import components

#: Ways to compare lines: characters of a shingle (a power of two and one), least length, length below.
#: Two lines of which one is below 120 and the other 150 or more have too different numbers of shingles.
VIEWS = ((5, 0, 150), (9, 120, 1 << 62))
#: Least similarity, and the signature: a pair at 0.8 shares a band with probability 0.998, at 0.85 with 0.9998.
SIMILARITY, BANDS, ROWS = 0.8, 12, 4
#: Bits of the bitmap of band values that two lines share: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26
#: Pairs between a bucket's parts, per line, up to which they are compared one by one; beyond, by prefix filter.
DIRECT = 64
#: Slots of the shingle counts that order prefixes: 1 MB to the tasks, whatever the corpus.
SLOTS = 1 << 20
#: Sets that a prefix may find up to which they are compared one by one; beyond, by counting.
COUNTED = 8
#: Shingles of a block; a task holds the shingle sets of two.
BLOCK_SHINGLES = 1 << 18
#: Blocks beyond which a bucket goes through prefix lists: about as many as a line of 150 characters has prefix shingles.
LISTED = 32
#: Bits of a line's sketch, by which most pairs are turned down before their shingle sets are built.
SKETCH_BITS = 1 << 12
#: Lines for which there is a slot of band values, and values that a scan holds before it sends them.
SLOT_LINES, SENT = 1 << 14, 1 << 21
#: Rows of a batch where rows are a line's hashes, without its text.
NARROW = 1 << 13
#: Shingles that are hashed at once, so that numpy stays in the cache.
BLOCK = 1 << 16

_SPACE = " \t\n\x0b\x0c\r"


def norm(line: str) -> str:
    """What is compared of a line: lower case, each run of ASCII white space as one space."""
    return b" ".join(line.lower().encode("utf-8", "replace").split()).decode()


def lines(text: str) -> list[tuple[int, str]]:
    """(number, normalised line) of the lines that have a word."""
    text = text.lower()
    if any(c in text for c in ("  ", "\t", "\r", "\x0b", "\x0c")):
        return [(i, n) for i, x in enumerate(text.split("\n")) if (n := norm(x))]
    return [(i, n) for i, x in enumerate(text.split("\n")) if (n := x.strip(" "))]


def uncollected(scan):
    """A scan of batches without collector runs: it makes millions of small objects and no cycles."""

    def run(batches):
        collects = gc.isenabled()
        gc.disable()
        try:
            yield from scan(batches)
        finally:
            if collects:
                gc.enable()

    return run


def key(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def shingles(line: str, k: int) -> set[str]:
    """A line's shingles of ``k`` characters; a shorter line is its own shingle."""
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def in_view(n: int, view: int) -> bool:
    """Whether a line of ``n`` characters is compared in this way."""
    return VIEWS[view][1] <= n < VIEWS[view][2]


def alike(a: str, b: str) -> bool:
    """Whether two lines are similar in a view that holds both."""
    return any(in_view(len(a), v) and in_view(len(b), v) and similar(shingles(a, k), shingles(b, k)) for v, (k, *_) in enumerate(VIEWS))


def similar(a: set[str], b: set[str]) -> bool:
    """Exact test of Jaccard similarity, in integers: |A ∩ B| / |A ∪ B| >= SIMILARITY."""
    small, large = sorted((len(a), len(b)))
    if 10 * small < round(10 * SIMILARITY) * large:
        return False
    both = len(a & b)
    return 10 * both >= round(10 * SIMILARITY) * (small + large - both)


# ---- signatures ------------------------------------------------------------------------

_rng = np.random.default_rng(42)
_ODD = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).tolist()
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32).tolist()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands(some: list[str], view: int) -> np.ndarray:
    """The band values (signed 64-bit, the lowest bit names the view) of each line, shape (lines, BANDS)."""
    out = np.empty((len(some), BANDS), np.int64)
    begin, size = 0, 0
    for i, line in enumerate(some):
        size += len(line)
        if size >= BLOCK or i == len(some) - 1:
            out[begin : i + 1] = _bands(some[begin : i + 1], view)
            begin, size = i + 1, 0
    return out


def _hashes(some: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes of all shingles of ``k`` characters, line after line, and where each line's begin."""
    some = [x if len(x) >= k else x.ljust(k, "\0") for x in some]
    c = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
    h, power = c * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F), 0x9E3779B1
    for span in (1 << j for j in range((k - 1).bit_length() - 1)):  # doubles the span up to k - 1 characters, then comes one more
        h = h[:-span] * np.uint32(power) + h[span:]
        power = power * power % (1 << 32)
    h = h[:-1] * np.uint32(0x9E3779B1) + c[k - 1 :] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    length = np.fromiter(map(len, some), np.int64, len(some))
    own = length - k + 1
    ends = np.cumsum(length)
    fits = np.ones(len(h) + k, bool)  # shingles that don't run over a line's end
    for back in range(1, k):
        fits[ends - back] = False
    return h[fits[: len(h)]], np.cumsum(own) - own


def _bands(some: list[str], view: int) -> np.ndarray:
    h, starts = _hashes(some, VIEWS[view][0])
    out, mixed = np.empty((len(some), BANDS), np.int64), np.empty_like(h)
    for band in range(BANDS):
        value = np.full(len(some), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(h, np.uint32(_XOR[i]), out=mixed)
            np.multiply(mixed, np.uint32(_ODD[i]), out=mixed)
            value = (value ^ np.minimum.reduceat(mixed, starts)) * _MIX
            value ^= value >> np.uint64(29)
        out[:, band] = (value >> np.uint64(1) << np.uint64(1) | np.uint64(view)).view(np.int64)
    return out


def _band_lists(some: list[str]) -> pa.ListArray:
    """The band values of each line in all its views."""
    length = np.fromiter(map(len, some), np.int64, len(some))
    rows, values = [], []
    for view, (_, least, below) in enumerate(VIEWS):
        own = np.flatnonzero((length >= least) & (length < below))
        rows.append(np.repeat(own, BANDS))
        values.append(bands([some[i] for i in own.tolist()], view).reshape(-1))
    rows, values = np.concatenate(rows), np.concatenate(values)
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(some)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[np.argsort(rows, kind="stable")]))


# ---- scans of the documents ------------------------------------------------------------

def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line: key and place (doc_id, row, line); the first row of a line in its batch has its length and band values too."""
    for batch in batches:
        found: dict[str, int] = {}
        which, numbers, count = [], [], []
        for text in batch.column("t").to_pylist():
            own = lines(text)
            which += [found.setdefault(line, len(found)) for _, line in own]
            numbers += [number for number, _ in own]
            count.append(len(own))
        some = list(found)
        of = np.array(which, np.int64)
        _, first = np.unique(of, return_index=True)
        at = np.full(len(of), -1)  # where a row's band values are
        at[first] = np.arange(len(some))
        at = pa.array(at, mask=at < 0)
        rows = pa.array(np.repeat(np.arange(len(count)), count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key(x) for x in some], pa.binary()).take(pa.array(of)), pa.array([len(x) for x in some], pa.int32()).take(at), _packed(_band_lists(some)).take(at),
             batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(numbers, pa.int32())],
            names=["key", "n", "bands", "doc_id", "row", "line"],
        )


def _packed(values: pa.ListArray) -> pa.BinaryArray:
    """The lists' 64-bit values as bytes."""
    ends = values.offsets.to_numpy().astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.values.to_numpy())])


def _unpacked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a column of bytes, and the row of each."""
    each = values.to_pylist()
    n = np.array([len(x or b"") // 8 for x in each], np.int64)
    return np.frombuffer(b"".join(x for x in each if x), np.int64), np.repeat(np.arange(len(each)), n)


def _heads(keys: pa.Array) -> np.ndarray:
    """The first 64 bits of each key."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.int64)[::2]


def _sent(slots: int):
    """mapInArrow function: a partition's band values with the least and greatest head of their lines, and the heads
    of its lines (twice if they come again), in a row per slot; equal values have one slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            values, at = _unpacked(batch.column("bands"))
            head = _heads(batch.column("key"))
            held.append((values, head[at], head))
            size += len(values) + len(head)
            if size >= SENT:
                yield _slot_rows(held, slots)
                held, size = [], 0
        if held:
            yield _slot_rows(held, slots)

    return run


def _slot_rows(held: list[tuple[np.ndarray, ...]], slots: int) -> pa.RecordBatch:
    values, of, head = (np.concatenate(x) for x in zip(*held, strict=True))
    values, least, most = _extremes(values, of, of)
    again = np.flatnonzero(least != most)
    values, of = np.concatenate([values, values[again]]), np.concatenate([least, most[again]])
    head, n = np.unique(head, return_counts=True)
    head = np.concatenate([head, head[n > 1]])
    columns, full = [], np.zeros(slots, bool)
    for by, those in ((values, (values, of)), (head, (head,))):
        slot = (by.view(np.uint64) >> np.uint64(20)) % np.uint64(slots)
        order = np.argsort(slot, kind="stable")
        n = np.bincount(slot.astype(np.int64), minlength=slots)
        full |= n > 0
        ends = (np.concatenate([[0], np.cumsum(n)]) * 8).astype(np.int32)
        columns += [pa.Array.from_buffers(pa.binary(), slots, [None, pa.py_buffer(ends), pa.py_buffer(x[order])]) for x in those]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), *columns], names=["slot", "values", "of", "heads"])
    return batch.take(pa.array(np.flatnonzero(full)))


def _extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, with the least of ``low`` and the greatest of ``high`` of each."""
    if not len(values):
        return values, low, high
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _shared_values(slot: pa.Table) -> pa.Table:
    """A slot's band values that different lines have, with the least head of these, and (least null) the heads that come more than once."""
    values, of, head = (np.frombuffer(b"".join(slot.column(c).to_pylist()), np.int64) for c in ("values", "of", "heads"))
    values, least, most = _extremes(values, of, of)
    shared = least != most
    head, n = np.unique(head, return_counts=True)
    value = np.concatenate([values[shared], head[n > 1]])
    return pa.table({"value": value, "least": pa.array(np.concatenate([least[shared], head[n > 1]]), mask=np.arange(len(value)) >= shared.sum())})


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _marked_bands(bits: Broadcast):
    """mapInArrow function: (bucket, key, h, n) of the band values that another line may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _unpacked(batch.column("bands"))
            hit = np.flatnonzero(_marked(bits.value, values))
            rows = pa.array(at[hit])
            key = batch.column("key").take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(values[hit]), key, pa.array(_heads(key)), batch.column("n").take(rows)], names=["bucket", "key", "h", "n"])

    return run


def _marked_texts(bits: Broadcast):
    """mapInArrow function: distinct lines whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = list(dict.fromkeys(line for t in batch.column("t").to_pylist() for _, line in lines(t)))
            keys = pa.array([key(x) for x in some], pa.binary())
            rows = pa.array(np.flatnonzero(_marked(bits.value, _heads(keys))))
            yield pa.RecordBatch.from_arrays([keys.take(rows), pa.array(some, pa.string()).take(rows)], names=["key", "t"])

    return run


def _marked_places(bits: Broadcast):
    """mapInArrow function: the rows of lines whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(_marked(bits.value, _heads(batch.column("key"))))))

    return run


def _key_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_heads(batch.column("node")))], names=["h"])


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """One bit per value modulo ``BITMAP_BITS``; at most 2,048 rows of 4 KB reach the driver."""
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    rows = values.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for k, bits in rows.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


# ---- prefix filter ---------------------------------------------------------------------

def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (t) with their numbers of shingles (by view, null outside)."""
    for batch in batches:
        some = batch.column("t").to_pylist()
        for v, (k, *_) in enumerate(VIEWS):
            batch = batch.append_column(f"size{v}", pa.array([len(shingles(x, k)) if in_view(len(x), v) else None for x in some], pa.int32()))
        yield batch


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): the shingles of a batch's lines (t) by their hash modulo ``SLOTS``."""
    for batch in batches:
        some = batch.column("t").to_pylist()
        of_view = [_hashes(own, k)[0] for v, (k, *_) in enumerate(VIEWS) if (own := [x for x in some if in_view(len(x), v)])]
        slot, n = np.unique(np.concatenate([np.empty(0, np.uint32), *of_view]) % np.uint32(SLOTS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])


def _rarity(text: DataFrame) -> np.ndarray:
    """The logarithm, in eighths, of each slot's count; at most ``SLOTS`` rows of five bytes reach the driver."""
    counts = text.select("t").mapInArrow(_shingle_counts, "slot INT, n BIGINT").groupBy("slot").agg(F.sum("n").alias("n"))
    at = counts.select("slot", F.floor(8 * F.log2("n")).cast("short").alias("r")).toArrow()
    out = np.zeros(SLOTS, np.int16)
    out[at.column("slot").to_numpy()] = at.column("r").to_numpy()
    return out


def _prefix_lists(rarity: Broadcast):
    """mapInArrow function: lines with the bands of their heavy buckets to (bucket, key, n, part) of a list per band and prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, of = batch.column("t").to_pylist(), batch.column("buckets").to_pylist()
            rows, lists = [], []
            for view, (k, *_) in enumerate(VIEWS):
                own = [(i, values) for i, each in enumerate(of) if (values := [b for b in each if b & 1 == view])]
                if not own:
                    continue
                h, starts = _hashes([some[i] for i, _ in own], k)
                sizes = batch.column(f"size{view}").to_pylist()
                for (i, values), one in zip(own, np.split(h, starts[1:]), strict=True):
                    one = np.unique(one)  # two shingles of one hash only lengthen the prefix
                    least = sizes[i] - math.ceil(SIMILARITY * sizes[i] - 1e-9) + 1
                    prefix = one[np.lexsort((one, rarity.value[one % np.uint32(SLOTS)]))[:least]].astype(np.uint64)
                    for b in values:
                        x = (np.uint64(b & (1 << 64) - 1) ^ prefix * _MIX) * _MIX
                        lists.append((x ^ x >> np.uint64(32)) >> np.uint64(1) << np.uint64(1) | np.uint64(view))
                        rows.append(np.full(len(x), i))
            at = pa.array(np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64))
            bucket = np.concatenate([np.empty(0, np.uint64), *lists]).view(np.int64)
            length = pa.array([len(x) for x in some], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("key").take(at), length.take(at), batch.column("part").take(at)], names=["bucket", "key", "n", "part"])

    return run


# ---- verification ----------------------------------------------------------------------

def _sketches(some: list[str], view: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's shingles as bits by their hash, packed, and how many shingles it has at most; none outside the view."""
    bits, most = np.zeros((len(some), SKETCH_BITS // 64), np.uint64), np.zeros(len(some), np.int64)
    own = [i for i, x in enumerate(some) if in_view(len(x), view)]
    if own:
        h, starts = _hashes([some[i] for i in own], VIEWS[view][0])
        n = np.diff(np.append(starts, len(h)))
        each = np.zeros((len(own), SKETCH_BITS), bool)
        each.reshape(-1)[np.repeat(np.arange(len(own)) * SKETCH_BITS, n) + h % np.uint32(SKETCH_BITS)] = True
        bits[own], most[own] = np.packbits(each, axis=1).view(np.uint64), n
    return bits, most


def may_be_similar(ta: list[str], tb: list[str]) -> np.ndarray:
    """Which pairs of lines can be similar: a bit that only one of two lines has is a shingle that only one has,
    and of similar lines these are at most (1 - s) / (1 + s) of the shingles of both."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(x, len(ids)) for x in t], np.int64) for t in (ta, tb))
    may, some, least = np.zeros(len(a), bool), list(ids), round(10 * SIMILARITY)
    for view in range(len(VIEWS)):
        bits, most = _sketches(some, view)
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        may |= (most[a] > 0) & (most[b] > 0) & ((10 + least) * apart <= (10 - least) * (most[a] + most[b]))
    return may


def alike_pairs(ta: list[str], tb: list[str]) -> list[bool]:
    """:func:`alike` of each pair of lines."""
    out = [False] * len(ta)
    for view, (k, *_) in enumerate(VIEWS):
        own = [i for i, (a, b) in enumerate(zip(ta, tb, strict=True)) if not out[i] and in_view(len(a), view) and in_view(len(b), view)]
        for i, yes in zip(own, _similar_pairs([ta[i] for i in own], [tb[i] for i in own], k), strict=True):
            out[i] = yes
    return out


def _similar_pairs(ta: list[str], tb: list[str], k: int) -> list[bool]:
    """Exact test of each pair by shingles of ``k`` as sorted numbers; sets of strings where lines are shorter or have too many letters."""
    if not ta:
        return []
    some = list(dict.fromkeys(ta + tb))
    codes = _codes(some, k) if min(map(len, some)) >= k else None
    if codes is None:
        if len(ta) == 1:
            return [similar(shingles(ta[0], k), shingles(tb[0], k))]
        half = len(ta) // 2
        return _similar_pairs(ta[:half], tb[:half], k) + _similar_pairs(ta[half:], tb[half:], k)
    of, least, out = dict(zip(some, codes, strict=True)), round(10 * SIMILARITY), []
    for a, b in zip(ta, tb, strict=True):
        x, y = of[a], of[b]
        all_ = np.concatenate((x, y))
        all_.sort()
        both = int(np.count_nonzero(all_[1:] == all_[:-1]))
        out.append(10 * both >= least * (len(x) + len(y) - both))
    return out


def _codes(some: list[str], k: int) -> list[np.ndarray] | None:
    """Each line's different shingles as sorted numbers, one number per shingle; None if 64 bits don't hold ``k`` of the letters."""
    c = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
    there = np.zeros(int(c.max()) + 1, bool)
    there[c] = True
    bits = max(1, int(there.sum() - 1).bit_length())
    if bits * k > 64:
        return None
    c = (np.cumsum(there) - 1).astype(np.uint64)[c]
    code = c
    for span in (1 << j for j in range((k - 1).bit_length() - 1)):
        code = code[:-span] << np.uint64(bits * span) | code[span:]
    code = code[:-1] << np.uint64(bits) | c[k - 1 :]
    out, begin = [], 0
    for x in some:
        own = np.sort(code[begin : begin + len(x) - k + 1])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        begin += len(x)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of keys whose lines (ta, tb) are similar."""
    for batch in batches:
        ta, tb = (batch.column(c).to_pylist() for c in ("ta", "tb"))
        keep = np.flatnonzero(may_be_similar(ta, tb)).tolist()
        found = alike_pairs([ta[i] for i in keep], [tb[i] for i in keep])
        keep = [i for i, yes in zip(keep, found, strict=True) if yes]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def part_links(rows: list[tuple[bytes, int, str]], k: int, direct: int = DIRECT) -> Iterator[tuple[bytes, bytes]]:
    """Similar pairs, by shingles of ``k``, among (key, part, line), enough to join all parts that a pair joins.

    Rows of one part are never compared.  Few pairs of other rows (a large part
    and some outsiders) are compared one by one, many through a prefix filter:
    with the shingles ordered by rarity in the bucket, two sets that are similar
    share one of their first n - ceil(0.8 n) + 1, and of what that finds the
    shared shingles are counted.
    """
    sets = [shingles(line, k) for _, _, line in rows]
    part = list(range(len(rows)))

    def find(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    first: dict[int, int] = {}
    for i, (_, p, _) in enumerate(rows):
        part[i] = first.setdefault(p, i)
    members: dict[int, list[int]] = defaultdict(list)
    for i, (_, p, _) in enumerate(rows):
        members[p].append(i)
    if (len(rows) ** 2 - sum(len(m) ** 2 for m in members.values())) // 2 <= direct * len(rows):
        by_size = sorted(members, key=lambda p: len(members[p]))
        for a, p in enumerate(by_size):
            for i in members[p]:
                for q in by_size[a + 1 :]:
                    if find(i) != find(first[q]):
                        j = next((j for j in members[q] if similar(sets[i], sets[j])), None)
                        if j is not None:
                            part[max(find(i), find(j))] = min(find(i), find(j))
                            yield rows[i][0], rows[j][0]
        return
    yield from ((rows[i][0], rows[j][0]) for i, j in _counted_links(sets, np.array(part)))


def _counted_links(sets: list[set[str]], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Similar pairs of sets with different labels, enough to join all labels that a pair joins.

    A set's prefix finds which earlier sets can be similar; where they are many,
    one pass over the postings of all its shingles counts what it shares with
    each of them.
    """
    ids: dict[str, int] = {}
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter((ids.setdefault(s, len(ids)) for one in sets for s in one), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = flat[np.lexsort((flat, np.bincount(flat)[flat], owner))]  # each set's shingles, rare ones first
    ends = np.cumsum(sizes)
    least = round(10 * SIMILARITY)
    prefix = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) <= np.repeat(sizes - -(-least * sizes // 10), sizes)
    every, first = _postings(flat, owner), _postings(flat[prefix], owner[prefix])
    first_ends = np.cumsum(np.bincount(owner[prefix], minlength=len(sets)))
    for i in range(1, len(sets)):
        met = np.unique(_earlier(first, first_ends[i - 1], first_ends[i]))
        met = met[label[met] != label[i]]
        if len(met) > COUNTED:
            both = np.bincount(_earlier(every, ends[i - 1], ends[i]), minlength=len(sets))[met]
            met = met[10 * both >= least * (sizes[i] + sizes[met] - both)]
        else:
            met = np.array([j for j in met.tolist() if similar(sets[i], sets[j])], np.int64)
        while len(met):
            yield i, int(met[0])
            label[label == label[met[0]]] = label[i]
            met = met[label[met] != label[i]]


def _postings(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry (shingle, set) where the earlier sets with its shingle begin and end in the third array."""
    by = np.argsort(flat, kind="stable")
    end = np.empty(len(flat), np.int64)
    end[by] = np.arange(len(flat))
    return np.searchsorted(flat[by], flat), end, owner[by]


def _earlier(postings: tuple[np.ndarray, np.ndarray, np.ndarray], begin: int, end: int) -> np.ndarray:
    """The earlier sets that share a shingle with the entries from ``begin`` to ``end``, once per shingle."""
    low, high, sets = postings[0][begin:end], postings[1][begin:end], postings[2]
    n = high - low
    return sets[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and two of its blocks (bucket, i, j) to the links that join their parts."""
    held, now, out = [], None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "key", "part", "t")]
        for bucket, i, j, k, p, t in zip(*columns, strict=True):
            if (bucket, i, j) != now:
                out += part_links(held, VIEWS[now[0] & 1][0] if now else 0)
                held, now = [], (bucket, i, j)
            held.append((k, p, t))
        yield _pairs(out)
        out = []
    yield _pairs(part_links(held, VIEWS[now[0] & 1][0] if now else 0))


def _pairs(links) -> pa.RecordBatch:
    links = list(links)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])


def shared_values(rows: DataFrame, kept: Staged) -> DataFrame:
    """(value, least): the band values that different lines have, with the least head of these, and, without it,
    the heads of the keys that stand in several rows of :func:`_line_rows`."""
    slots = 1024 + rows.count() // SLOT_LINES
    sent = rows.select("key", "bands").mapInArrow(_sent(slots), "slot INT, values BINARY, of BINARY, heads BINARY")
    with batch_rows(rows.sparkSession, NARROW):
        return kept.keep(sent.groupBy("slot").applyInArrow(_shared_values, "value BIGINT, least BIGINT"), "shared")


def links(texts: DataFrame, rows: DataFrame, shared: DataFrame, kept: Staged) -> DataFrame:
    """(node, root): every line that is similar to a different one, by key, with its component.

    ``rows`` are the stored rows of :func:`_line_rows` for ``texts`` (t), ``shared`` is of :func:`shared_values`.
    """
    context = texts.sparkSession.sparkContext
    shared = shared.where("least IS NOT NULL").select(F.col("value").alias("bucket"), "least")
    hot = context.broadcast(_bitmap(shared, "bucket"))
    members = rows.where("bands IS NOT NULL").select("key", "n", "bands").mapInArrow(_marked_bands(hot), "bucket BIGINT, key BINARY, h BIGINT, n INT")
    members = members.join(shared, "bucket").select("bucket", "key", "h", "n", (F.col("h") == F.col("least")).alias("pivot")).distinct()
    with batch_rows(texts.sparkSession, NARROW):
        members = kept.keep(members, "members")
    wanted = context.broadcast(_bitmap(members, "h"))
    text = texts.select("t").mapInArrow(uncollected(_marked_texts(wanted)), "key BINARY, t STRING").dropDuplicates(["key"])
    text = kept.keep(text, "texts")
    pivots = kept.keep(members.where("pivot").select("bucket", F.col("key").alias("first")), "pivots")
    pairs = members.join(pivots, "bucket").where("key <> first").select(F.greatest("key", "first").alias("a"), F.least("key", "first").alias("b")).distinct()
    pairs = kept.keep(pairs, "pairs")
    verified = kept.keep(_verify(pairs, text), "verified")
    parts = kept.keep(components(verified, kept), "parts")
    kept.drop(pivots, verified)
    rest = _in_parts(members, parts, kept)
    kept.drop(members)
    if rest.isEmpty():
        return parts
    heavy = kept.keep(_in_blocks(rest), "heavy")
    more = kept.keep(_light_links(rest, pairs, text).union(_block_links(heavy.where(f"blocks <= {LISTED}"), text)), "more")
    large = heavy.where(f"blocks > {LISTED}")
    if not large.isEmpty():
        lists = kept.keep(prefix_lists(large, text, kept), "lists")
        kept.drop(rest)
        pivots = kept.keep(lists.groupBy("bucket").agg(F.min(F.struct("key", "part")).alias("pivot")), "pivots")
        first = lists.join(pivots, "bucket").where("part <> pivot.part").select(F.col("key").alias("a"), F.col("pivot.key").alias("b")).distinct()
        first = kept.keep(first.join(pairs, ["a", "b"], "left_anti"), "first")
        found = kept.keep(_verify(first, text), "found")
        parts = kept.keep(components(parts.union(more).union(found), kept), "parts")
        rest = _in_parts(lists, parts, kept)
        kept.drop(lists, pivots)
        more = _light_links(rest, pairs.union(first), text).union(_block_links(_in_blocks(rest), text))
        more = kept.keep(more, "more")
    kept.drop(rest, pairs, text)
    return parts if more.isEmpty() else kept.keep(components(parts.union(more), kept), "parts")


def _in_parts(members: DataFrame, parts: DataFrame, kept: Staged) -> DataFrame:
    """(bucket, key, n, part, main, heavy) of the buckets of three or more lines that are in several parts.

    ``part`` is a hash of the part's root, ``main`` the largest part; a heavy bucket has more pairs of different parts than ``DIRECT`` a line.
    """
    labelled = members.join(parts, members["key"] == parts["node"], "left").select("bucket", "key", "n", F.xxhash64(F.coalesce("root", "key")).alias("part"))
    labelled = kept.keep(labelled, "labelled")
    sizes = labelled.groupBy("bucket", "part").agg(F.count("*").alias("m")).groupBy("bucket").agg(
        F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("q"), F.max_by("part", "m").alias("main"))
    open_ = kept.keep(sizes.where("`all` > 2 AND q < `all` * `all`").select("bucket", "main", F.expr(f"(`all` * `all` - q) div 2 > {DIRECT} * `all`").alias("heavy")), "open")
    rest = kept.keep(labelled.join(open_, "bucket"), "rest")
    kept.drop(labelled, open_)
    return rest


def _in_blocks(rest: DataFrame) -> DataFrame:
    """(bucket, key, n, part, blocks) of heavy buckets; a bucket has a block for every ``BLOCK_SHINGLES`` characters, so shingles at most."""
    heavy = rest.where("heavy").select("bucket", "key", "n", "part")
    return heavy.join(heavy.groupBy("bucket").agg(F.expr(f"sum(n) div {BLOCK_SHINGLES} + 1").alias("blocks")), "bucket")


def _light_links(rest: DataFrame, seen: DataFrame, text: DataFrame) -> DataFrame:
    """Similar pairs between the parts of buckets that aren't heavy: those of the lines outside the
    largest part, each pair once over all buckets and none that was ``seen``."""
    light = rest.where("NOT heavy")
    lone = light.where("part <> main").select("bucket", F.col("key").alias("a"), F.col("part").alias("pa"))
    other = light.select("bucket", F.col("key").alias("b"), F.col("part").alias("pb"), "main")
    some = lone.join(other, "bucket").where("pa <> pb AND (pb = main OR a < b)").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return _verify(some.join(seen, ["a", "b"], "left_anti"), text)


def prefix_lists(heavy: DataFrame, text: DataFrame, kept: Staged) -> DataFrame:
    """(bucket, key, n, part): a list per heavy bucket and prefix shingle, of the lines that have both.

    Two similar lines of a bucket share a list.  Any order of the shingles, the
    same for all lines, will do; rare ones first make short lists.
    """
    lines_of = heavy.groupBy("key").agg(F.first("part").alias("part"), F.collect_list("bucket").alias("buckets"))
    lines_of = lines_of.join(text, "key").select("key", "part", "t", "buckets")
    lines_of = kept.keep(lines_of.mapInArrow(uncollected(_sized), "key BINARY, part BIGINT, t STRING, buckets ARRAY<BIGINT>, size0 INT, size1 INT"), "listed")
    rarity = text.sparkSession.sparkContext.broadcast(_rarity(lines_of))
    return lines_of.mapInArrow(_prefix_lists(rarity), "bucket BIGINT, key BINARY, n INT, part BIGINT")


def _block_links(heavy: DataFrame, text: DataFrame) -> DataFrame:
    """Links that join the parts of heavy buckets or lists, every two blocks in a task."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    met = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own")),
                    lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))))
    dealt = heavy.join(text.select("key", "t"), "key").withColumn("own", own).select("bucket", F.explode(met).alias("at"), "key", "part", "t")
    dealt = dealt.select("bucket", "at.i", "at.j", "key", "part", "t")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    return dealt.mapInArrow(uncollected(_block_rows), "a BINARY, b BINARY")


def _verify(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose lines are similar."""
    ta, tb = (text.select(F.col("key").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(uncollected(_verified), "a BINARY, b BINARY")


def dropped_lines(docs: DataFrame, kept: Staged) -> DataFrame:
    """(row, lines): the numbers of the lines that go, for rows that lose any; ``docs`` has doc_id, row, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = f"doc_id {kind}, row BIGINT, line INT"
    texts = docs.select("doc_id", "row", text_or_empty().alias("t"))
    rows = kept.keep(texts.mapInArrow(uncollected(_line_rows), f"key BINARY, n INT, bands BINARY, {place}"), "lines")
    shared = shared_values(rows, kept)
    parts = links(texts, rows, shared, kept)
    # places of lines that come again or are similar to others: all others stay
    repeated = _bitmap(shared.where("least IS NULL"), "value") | _bitmap(parts.select("node").mapInArrow(_key_heads, "h BIGINT"), "h")
    wanted = docs.sparkSession.sparkContext.broadcast(repeated)
    places = rows.select("key", "doc_id", "row", "line").mapInArrow(_marked_places(wanted), f"key BINARY, {place}")
    places = places.join(parts, places["key"] == parts["node"], "left")
    with batch_rows(docs.sparkSession, NARROW):
        places = kept.keep(places.select(F.coalesce("root", "key").alias("root"), F.struct("doc_id", "row", "line").alias("place")), "places")
    kept.drop(rows, shared)
    stays = kept.keep(places.groupBy("root").agg(F.min("place").alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n"), "stays")
    gone = places.join(stays, "root").where(~F.col("place").eqNullSafe(F.col("stays"))).select("place.row", "place.line")
    return kept.keep(gone.groupBy("row").agg(F.collect_set("line").alias("lines")), "gone")


def without_lines(text: str, gone: str) -> Column:
    """The text without the lines of these numbers; the others, blank ones too, stay as they are."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, drop in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            if t is not None and drop:
                out_of = set(drop)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out_of)
            out.append(t)
        return pa.array(out, pa.string())

    return run(F.col(text), F.col(gone))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; ``n_chars`` follows where there is one.

    Every row stays, also one that loses all its lines (its text is then
    empty); null texts stay null and blank lines are never repeats.  Rows that
    repeat a doc_id or have none are judged one by one: of equal rows the first
    keeps its lines.  An empty table gives an empty table.
    """
    kept = Staged(docs.sparkSession, "linededup")
    row = free_name(docs, "_row")
    rows = kept.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = dropped_lines(rows.select("doc_id", F.col(row).alias("row"), "text"), kept)
    gone = gone.select(F.col("row").alias("_gone_row"), F.col("lines").alias("_gone"))
    # the table grows with the corpus: merged at any size, never broadcast
    joined = rows.join(gone.hint("merge"), rows[row] == gone["_gone_row"], "left")
    new = free_name(docs, "_text")
    joined = joined.withColumn(new, without_lines("text", "_gone"))
    size = lambda c: F.when(F.col("_gone").isNull(), rows[c]).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c)
    return joined.select(*[F.col(new).alias(c) if c == "text" else size(c) if c == "n_chars" else rows[c] for c in docs.columns])
