"""Operator 2 — packing by concatenate and cut.

Pass 1 encodes every document once and stores its ids with the number of the
partition it lies in and its offset there.  Prefix sums over the partitions'
token totals (one row per partition) turn these into offsets in the whole
stream; pass 2 cuts the stream at every ``window`` tokens.  A document that
crosses a cut gives one boundary record per window, so each id lies in exactly
one piece and only the very last sequence is short.

The stored table makes both passes see the same partitions; a retried task
writes the same rows.  Only the partition totals are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, utf8
from .wordcode import encoder, read_json

#: Tokens of a sequence, and the id that ends a document.
WINDOW, END_ID = 2048, 1


def _encode_rows(json_text: str, end_id: int):
    """mapInArrow function: (…, raw) to (…, part, at, n, ids) with running offsets in the partition."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, code = TaskContext.get().partitionId(), 0, encoder(json_text)
        for batch in batches:
            ids = [x + end for x in code.encode_all(batch.column("raw").to_pylist())]
            n = [len(x) // 4 for x in ids]
            starts = []
            for x in n:
                starts.append(at)
                at += x
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "at", "n", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, opens, closes.

    ``ids`` is the piece's tokens as little-endian uint32 bytes; ``opens`` and
    ``closes`` say whether the document's first and last token lie in it.  Null
    and empty texts are the end id alone.  Rows that repeat a doc_id are packed
    one by one, null ids too; an empty table gives an empty table.  Which
    document follows which is the table's own order of partitions and rows.
    Further columns are not read.
    """
    kept = Staged(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept.keep(
        docs.select("doc_id", utf8().alias("raw")).mapInArrow(
            _encode_rows(read_json(tokenizer_path), end_id), f"doc_id {kind}, part INT, at BIGINT, n BIGINT, ids BINARY"
        ),
        "ids",
    )
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(base), "part").withColumn("g", F.col("base") + F.col("at"))
    pieces = F.expr(f"""
        transform(sequence(g div {window}, (g + n - 1) div {window}), w -> named_struct(
            'sequence_id', w,
            'start', greatest(g, w * {window}) - g,
            'length', least(g + n, (w + 1) * {window}) - greatest(g, w * {window}),
            'offset', greatest(g, w * {window}) - w * {window},
            'ids', substring(ids, cast(4 * (greatest(g, w * {window}) - g) as int) + 1,
                             cast(4 * (least(g + n, (w + 1) * {window}) - greatest(g, w * {window})) as int))))
    """)
    return placed.select("doc_id", "n", F.explode(pieces).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset",
        (F.col("p.start") == 0).alias("opens"), (F.col("p.start") + F.col("p.length") == F.col("n")).alias("closes"),
    )


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, length): whole sequences, padded to ``window`` unless their length is a power of two.

    A sequence has at most ``window`` pieces, so the grouping is bounded.
    """
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (window - F.col("length")).cast("int")))
    short = (F.col("length") < window) & (F.bit_count("length") != 1)
    return one.select("sequence_id", F.when(short, F.concat(joined, pad)).otherwise(joined).alias("ids"), "length")
