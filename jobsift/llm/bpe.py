"""Operator 10 — BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts texts into chunks whose borders depend on
content alone, so that copies and shared passages give equal chunks wherever
they stand.

1. Chunks are counted by 128-bit hash (16 bytes a chunk move, combined
   map-side); those that occur twice or more are shared.
2. Each shared chunk is encoded once, wherever its first copy is met.
3. Documents without a shared chunk are encoded in place.  The others fetch
   the ids of their shared chunks by a join on the hash, encode the rest
   themselves, and repair every join of two chunks: the word that the cut went
   through is encoded anew together with a whole word on either side, and the
   window widens until its outer words have the ids that the chunks gave.

Only documents with shared chunks, and only shared chunks, cross the network
as texts.  Which chunks may be shared is told to the tasks by a bitmap of fixed
size; a bit set by another chunk costs a needless exchange, never a wrong id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, utf8
from .wordcode import WordEncoder, encoder, read_json

#: Chunk sizes in bytes: least, expected above the least (a power of two), most.
LEAST, EXPECTED, MOST = 256, 512, 8192
#: Bits of the bitmap of shared chunks: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26

_STEP = np.uint32(0x9E3779B1)  # odd multiplier of the rolling polynomial


def _powers() -> list[tuple[int, np.uint32]]:
    out, power = [], int(_STEP)
    for span in (1, 2, 4, 8):
        out.append((span, np.uint32(power)))
        power = power * power % (1 << 32)
    return out


def cuts(raw: bytes, least: int = LEAST, expected: int = EXPECTED, most: int = MOST) -> list[int]:
    """End positions of the chunks; they fall between characters, the last is the text's end.

    The hash of the 16 bytes before a position is a polynomial, doubled up
    from single bytes in four vector steps.
    """
    n = len(raw)
    if n <= least:
        return [n] if n else []
    h = (np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    for span, power in _powers():
        longer = h.copy()
        longer[span:] += power * h[:-span]
        h = longer
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    marks = (np.flatnonzero((h[15:] >> np.uint32(12)) % np.uint32(expected) == 0) + 16).tolist()
    out, last = [], 0
    for mark in [*marks, n]:
        while mark - last > most:
            last = _border(raw, last + most)
            out.append(last)
        if mark - last >= least and mark < n:
            last = _border(raw, mark)
            out.append(last)
    if last < n:
        out.append(n)
    return out


def _border(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def name(chunk: bytes) -> tuple[int, int]:
    """128-bit content hash as two signed integers."""
    h = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


# ---- one chunk, and documents from chunks ----------------------------------------------

def encode_chunk(code: WordEncoder, chunk: bytes) -> tuple[bytes, int, int]:
    """The chunk's ids, and how many bytes of them its first and its last word have.

    A chunk that begins or ends with white space has an empty word there.
    """
    words = code.words(chunk)
    first, last = (b"", b"") if not words else (b"" if chunk[:1].isspace() else words[0], b"" if chunk[-1:].isspace() else words[-1])
    ids = code.encode(chunk)
    head, tail = code.encode_all([first, last])
    return ids, len(head), len(tail)


def _after_word(raw: bytes, at: int) -> int:
    """The end of the word that stands at ``at``."""
    while at < len(raw) and not raw[at : at + 1].isspace():
        at += 1
    return at


def _before_word(raw: bytes, at: int) -> int:
    while at > 0 and not raw[at - 1 : at].isspace():
        at -= 1
    return at


def assemble(code: WordEncoder, raw: bytes, ends: list[int], coded: list[tuple[bytes, int, int] | None]) -> bytes:
    """The text's ids from its chunks' ids; None: the chunk is encoded here.

    Between two chunks only the word through which the cut goes can differ.
    Where a chunk has no white space, the word goes on into the next one.
    """
    out: list[bytes] = []
    begin, open_from = 0, 0  # the word that is still open began at open_from
    for end, one in zip(ends, coded, strict=True):
        chunk = raw[begin:end]
        if one is None:
            one = encode_chunk(code, chunk)
        ids, head, tail = one
        if len(chunk.split(None, 1)) < 2 and not (chunk[:1].isspace() or chunk[-1:].isspace()):
            begin = end  # a part of one word
            continue
        first = _after_word(raw, begin)
        last = _before_word(raw, end)
        if open_from == begin:  # the cut fell on white space: both sides agree as they are
            out.append(ids[:head])
        else:
            out.append(_repair(code, raw, open_from, first))
        out.append(ids[head : len(ids) - tail])
        begin, open_from = end, last
    if open_from < len(raw):
        out.append(code.encode(raw[open_from:]))
    return b"".join(out)


def _repair(code: WordEncoder, raw: bytes, a: int, b: int) -> bytes:
    """Ids of the word raw[a:b], encoded with its neighbours until their ids agree with their own."""
    left, right = a, b
    while True:
        left = _before_word(raw, max(left - 1, 0))
        right = _after_word(raw, min(right + 1, len(raw)))
        before, word, after = code.encode_all([raw[left:a], raw[a:b], raw[b:right]])
        window = code.encode(raw[left:right])
        if window.startswith(before) and window.endswith(after) and len(window) >= len(before) + len(after):
            return window[len(before) : len(window) - len(after)]
        if left == 0 and right == len(raw):
            return word


# ---- over Spark ------------------------------------------------------------------------

def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [name(c) for raw in batch.column("raw").to_pylist() for c in chunks(raw)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["h", "g"])


def shared_chunks(docs: DataFrame, kept: Staged) -> DataFrame:
    """(h, g) of the chunks that occur twice or more."""
    found = docs.select(utf8().alias("raw")).mapInArrow(_names, "h BIGINT, g BIGINT")
    return kept.keep(found.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "shared")


def bitmap(shared: DataFrame) -> np.ndarray:
    """One bit per value of h modulo ``BITMAP_BITS``; at most 2,048 rows of 4 KB reach the driver."""
    at = F.pmod(F.col("h"), F.lit(BITMAP_BITS)) + 1
    rows = shared.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for k, bits in rows.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _marked(bits: np.ndarray, h: int) -> bool:
    at = h % BITMAP_BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _shared_texts(bits: Broadcast):
    """mapInArrow function: chunks that may be shared, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n: c for raw in batch.column("raw").to_pylist() for c in chunks(raw) if _marked(bits.value, (n := name(c))[0])}
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[i] for n in found], pa.int64()) for i in (0, 1)] + [pa.array(list(found.values()), pa.binary())], names=["h", "g", "chunk"]
            )

    return run


def _encode_chunks(json_text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(json_text)
        for batch in batches:
            coded = [encode_chunk(code, c) for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("g"), pa.array([c[0] for c in coded], pa.binary()), *[pa.array([c[i] for c in coded], pa.int32()) for i in (1, 2)]],
                names=["h", "g", "ids", "head", "tail"],
            )

    return run


def _alone(json_text: str, bits: Broadcast):
    """mapInArrow function: ids of the documents without a chunk that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(json_text)
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            own = [i for i, raw in enumerate(raws) if not any(_marked(bits.value, name(c)[0]) for c in chunks(raw))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(code.encode_all([raws[i] for i in own]), pa.binary())], names=["doc_id", "ids"]
            )

    return run


def _sharing(bits: Broadcast):
    """mapInArrow function: the other documents, with the names of their chunks that may be shared."""
    ref = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("g", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = [
                [{"pos": i, "h": n[0], "g": n[1]} for i, n in enumerate(map(name, chunks(raw))) if _marked(bits.value, n[0])]
                for raw in batch.column("raw").to_pylist()
            ]
            rows = pa.array([i for i, r in enumerate(refs) if r], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("raw").take(rows), pa.array([r for r in refs if r], ref)], names=["doc_id", "raw", "refs"]
            )

    return run


def _assembled(json_text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(json_text)
        for batch in batches:
            ids = []
            for raw, got in zip(batch.column("raw").to_pylist(), batch.column("got").to_pylist(), strict=True):
                if any(s in raw for s in code.special):  # a special token may lie across a cut
                    ids.append(code.encode(raw))
                    continue
                ends = cuts(raw)
                by = {x["pos"]: (x["ids"], x["head"], x["tail"]) for x in got or ()}
                ids.append(assemble(code, raw, ends, [by.get(i) for i in range(len(ends))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): each row's ids as little-endian uint32 bytes, as the tokenizer gives for the whole text.

    Null and empty texts have no ids.  Rows that repeat a doc_id, or have none,
    are encoded one by one; an empty table gives an empty table.  Further
    columns are not read.
    """
    spark = docs.sparkSession
    kept = Staged(spark, "bpe")
    kind = docs.schema["doc_id"].dataType.simpleString()
    code = read_json(tokenizer_path)
    texts = docs.select("doc_id", utf8().alias("raw"))
    bits = spark.sparkContext.broadcast(bitmap(shared_chunks(docs, kept)))
    once = texts.select("raw").mapInArrow(_shared_texts(bits), "h BIGINT, g BIGINT, chunk BINARY").dropDuplicates(["h", "g"])
    coded = kept.keep(once.mapInArrow(_encode_chunks(code), "h BIGINT, g BIGINT, ids BINARY, head INT, tail INT"), "coded")
    sharing = texts.mapInArrow(_sharing(bits), f"doc_id {kind}, raw BINARY, refs ARRAY<STRUCT<pos: INT, h: BIGINT, g: BIGINT>>")
    sharing = kept.keep(sharing.withColumn("row", F.monotonically_increasing_id()), "sharing")
    refs = sharing.select("row", F.explode("refs").alias("r")).select("row", "r.pos", "r.h", "r.g")
    got = refs.join(coded, ["h", "g"]).groupBy("row").agg(F.collect_list(F.struct("pos", "ids", "head", "tail")).alias("got"))
    joined = sharing.select("row", "doc_id", "raw").join(got, "row", "left").select("doc_id", "raw", "got")
    ids = f"doc_id {kind}, ids BINARY"
    return texts.mapInArrow(_alone(code, bits), ids).union(joined.mapInArrow(_assembled(code), ids))


def decode_column(ids: str, tokenizer_path: str) -> Column:
    """The text that the tokenizer's decode gives for a column of ids, special tokens included."""
    json_text = read_json(tokenizer_path)

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        code = encoder(json_text)
        return pa.array([None if x is None else code.decode(x) for x in rows.to_pylist()], pa.string())

    return run(F.col(ids))
