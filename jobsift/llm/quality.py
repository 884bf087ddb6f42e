"""Operator 8 — quality rules with thresholds from mergeable quantile sketches.

Every document gets counts of words, symbols, repeats and so on.  From these
come a few integer ratios, and each ratio's distribution is sketched per
language and source: a sketch is the number of documents per bucket of a
high-dynamic-range histogram (exact below 64, then 32 buckets per power of
two, so quantiles err by at most 1/32).  Sketches merge by adding counts —
Spark's map-side aggregation — and the result depends neither on order nor on
partitioning; the sketch of a language is the merge of its sources', that of
the corpus the merge of all.  Documents that fail the contract's fixed rules
are in no sketch.

The threshold of a ratio lies beyond the upper part of its distribution:
``q85 + REACH * max(q85 - median, q85 / 32, 1)``, so up to a seventh of a group may
be junk without moving it, and the resolution of the sketch is the only floor.
Average word length also has the mirrored lower threshold.  The threshold of a
source with n documents is the mean of its own, weighted n², and its language's,
weighted ``PRIOR``²; a language's is blended with the corpus' in the same way.

A ratio of counts that are zero almost everywhere has a threshold near zero, so
single counts need a tolerance: two symbols, two repeated lines and the forty
words of a line of twenty that stands twice are taken off before a document is
compared (``TOLERANCE``); they don't grow with the text.

Thresholds are one row per (language, source) and come back to the documents by
a join, which is broadcast only if adaptive execution sees that the table is
small, and split otherwise where a source is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, free_name, text_or_empty

#: The contract's symbol characters, and its two fixed rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
#: The quantile (percent) and its distance from the median, in which the threshold's distance beyond it is measured.
UPPER, REACH = 85, 8
#: Documents that a parent's threshold counts for.
PRIOR = 100
#: Documents from which on a group's weight stays the same (its parent's share is then under 1e-8): squares stay in 64 bits.
MOST = 1_000_000

#: Ratio → (numerator, factor, denominator).
RATIOS = {
    "symbols": ("n_symbols", 1000, "n_words"),
    "dup_lines": ("n_dup_lines", 1000, "n_lines"),
    "repeats": ("n_repeat_words", 1000, "n_words"),
    "upper": ("n_upper", 1000, "n_letters"),
    "punctuation": ("n_punctuation", 1000, "n_words"),
    "word_length": ("word_chars", 100, "n_words"),
}
#: Counts that are taken off a numerator before a document is compared with a threshold.
TOLERANCE = {"symbols": 2, "dup_lines": 2, "repeats": 40}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_punctuation"]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS)
_SPACE = " \t\n\x0b\x0c\r"


def counts(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes: ASCII white space
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _LETTERS)),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _PUNCTUATION)),
    )


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: set = set()
    twice = set() if len(set(windows)) == len(windows) else {w for w in windows if w in seen or seen.add(w)}
    if not twice:
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def counts_column(text: str = "text") -> Column:
    """A struct of ``COUNTS``; a null text has no words."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = [counts(x) for x in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)

    return run(text_or_empty(text))


def ratio(name: str, at: str = "", tolerance: int = 0) -> Column:
    above, factor, below = RATIOS[name]
    return F.expr(f"if({at}{below} > 0, (greatest({at}{above} - {tolerance}, 0L) * {factor}) div {at}{below}, 0L)")


def base_failed(at: str = "") -> Column:
    return F.expr(f"{at}n_words < {MIN_WORDS} OR 100 * {at}n_repeat_words > {MAX_REPEAT} * {at}n_words")


def bucket(value: Column) -> Column:
    """The value itself below 64; above, its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) over rows with counts, of the documents that pass the fixed rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(ratio(k)).alias("bucket")) for k in RATIOS]))
    return (
        rows.where(~base_failed()).select("lang", "source", each.alias("r"))
        .groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): ``high_<ratio>`` for each ratio and ``low_word_length``."""
    merged = [
        sketch.withColumn("level", F.lit(2)),
        sketch.withColumn("source", F.lit(None).cast("string")).withColumn("level", F.lit(1)),
        sketch.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("level", F.lit(0)),
    ]
    key = ["level", "lang", "source", "ratio"]
    every = merged[0].unionByName(merged[1]).unionByName(merged[2])
    every = every.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*key)
    every = every.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    cuts = every.groupBy(*key).agg(F.max("total").alias("total"), at(100 - UPPER).alias("lower"), at(50).alias("middle"), at(UPPER).alias("upper"))
    spread = lambda a, b: reach * F.greatest(F.col(a) - F.col(b), F.expr("upper div 32"), F.lit(1))
    cuts = cuts.select(
        *key, "total", (F.col("upper") + spread("upper", "middle")).alias("high"), F.greatest(F.col("lower") - spread("middle", "lower"), F.lit(0)).alias("low"),
    )
    names = [f"high_{k}" for k in RATIOS] + ["low_word_length"]
    wide = cuts.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("ratio") == k, F.col("high"))).alias(f"high_{k}") for k in RATIOS],
        F.max(F.when(F.col("ratio") == "word_length", F.col("low"))).alias("low_word_length"),
    )
    own, up, top = (wide.where(F.col("level") == n).alias(x) for n, x in ((2, "own"), (1, "up"), (0, "top")))

    def blended(name: str) -> Column:
        square = lambda at: f"(least({at}.total, {MOST}) * least({at}.total, {MOST}))"
        language = f"(({square('up')} * up.{name} + {prior**2} * top.{name}) div ({square('up')} + {prior**2}))"
        return F.expr(f"({square('own')} * own.{name} + {prior**2} * {language}) div ({square('own')} + {prior**2})").alias(name)

    out = own.join(up, F.col("own.lang").eqNullSafe(F.col("up.lang"))).join(top, F.col("top.level") == F.col("own.level") - 2)
    return out.select("own.lang", "own.source", *map(blended, names))


def passes(at: str = "", limits: str = "") -> Column:
    """The verdict: the contract's fixed rules, then every ratio within its thresholds."""
    fine = ~base_failed(at)
    for k in RATIOS:
        fine = fine & (ratio(k, at, TOLERANCE.get(k, 0)) <= F.col(f"{limits}high_{k}"))
    return F.coalesce(fine & (ratio("word_length", at) >= F.col(f"{limits}low_word_length")), F.lit(False))


def quality(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, the counts, base_failed, kept.

    A null text has no words and fails; a null language or source is a group of
    its own; rows that repeat a doc_id are judged one by one; an empty table
    gives an empty table.  Further columns are not read.
    """
    kept = Staged(docs.sparkSession, "quality")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), counts_column().alias("c"))
    rows = kept.keep(rows.select("doc_id", "lang", "source", "c.*"), "counts")
    limits = kept.keep(thresholds(kept.keep(sketches(rows), "sketch"), reach, prior), "limits")
    same = rows["lang"].eqNullSafe(limits["lang"]) & rows["source"].eqNullSafe(limits["source"])
    return rows.join(limits, same, "left").select(
        rows["doc_id"], rows["lang"], rows["source"], *COUNTS, base_failed().alias("base_failed"), passes().alias("kept")
    )


def keep_good(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are.

    The verdict is made on the row itself, so null and repeated ids need no care.
    """
    kept = Staged(docs.sparkSession, "quality")
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), counts_column().alias("c"))
    limits = kept.keep(thresholds(kept.keep(sketches(rows.select("lang", "source", "c.*")), "sketch"), reach, prior), "limits")
    limits = limits.select(*[F.col(c).alias(f"_limit_{c}") for c in limits.columns])
    c = free_name(docs, "_counts")
    marked = docs.withColumn(c, counts_column())
    same = docs["lang"].cast("string").eqNullSafe(limits["_limit_lang"]) & docs["source"].cast("string").eqNullSafe(limits["_limit_source"])
    return marked.join(limits, same, "left").where(passes(f"{c}.", "_limit_")).select(*[docs[x] for x in docs.columns])
