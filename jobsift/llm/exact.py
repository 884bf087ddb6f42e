"""Operator 7 [native] — exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters.  Blocks
are sorted by (64-bit hash, content); a block's integer name is its hash,
with its rank among the *different* contents under that hash as second digit
(0 for all but real collisions, which are found by comparing contents).  Then
adjacent pairs of names are named the same way, level by level, until a
document has one name: equal names mean equal texts, whatever the hash does.

Scale: contents cross one shuffle, as distinct (hash, block) rows combined
map-side, so a block that a third of the rows share costs one row per task.
Everything else moves names of 12 bytes.  Group sizes and smallest ids combine
map-side; the join that returns them to documents reads two stored tables, so
a hot group is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, Staged, text_or_empty

#: Characters of a block: most documents are one block, long ones a few.
BLOCK_CHARS = 4096


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), WS, " ")


def _hash(*cols: Column, bits: int) -> Column:
    h = F.xxhash64(*cols)
    return h if bits >= 64 else h.bitwiseAND((1 << bits) - 1)


def _ranks(distinct: DataFrame, content: list[str], kept: Staged) -> DataFrame | None:
    """(h, content…, r) of the contents that share their hash with another one; None if there are none."""
    shared = kept.keep(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    if shared.isEmpty():  # as ever with 64 bits: the contents needn't move again
        return None
    rank = F.row_number().over(Window.partitionBy("h").orderBy(*content)) - 1
    return kept.keep(distinct.join(shared, "h").withColumn("r", rank.cast("int")), "ranks")


def _named(rows: DataFrame, ranks: DataFrame, content: list[str]) -> DataFrame:
    """Rows (row, pos, h, content…) folded to (row, names)."""
    same = [rows["h"] == ranks["h"], *(rows[c].eqNullSafe(ranks[c]) for c in content)]
    named = rows.join(ranks, same, "left").select(
        rows["row"], rows["pos"], F.struct(rows["h"], F.coalesce("r", F.lit(0)).alias("r")).alias("name")
    )
    return named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names")).select(
        "row", F.col("names.name").alias("names")
    )


def identities(docs: DataFrame, kept: Staged, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, level, h, r): equal (level, h, r) ⇔ equal normalised texts.

    One row per input row; a row number given once to the stored rows keeps
    repeated or null ids apart.  ``hash_bits`` is lowered by tests to force
    collisions.
    """
    texts = docs.select("doc_id", normalised().alias("t"))
    blocks = _blocks_of("t", block_chars)
    contents = texts.select(F.explode(blocks).alias("block")).select(_hash(F.col("block"), bits=hash_bits).alias("h"), "block")
    ranks = _ranks(contents.distinct(), ["block"], kept)
    name = lambda b: F.struct(_hash(b, bits=hash_bits).alias("h"), F.lit(0).cast("int").alias("r"))
    cut = texts.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("t", 256).alias("text_sha256"),
        F.transform(blocks, name).alias("names") if ranks is None else blocks.alias("blocks"),
    )
    rows = kept.keep(cut, "rows")
    if ranks is not None:
        exploded = rows.select("row", F.posexplode("blocks").alias("pos", "block"))
        exploded = exploded.withColumn("h", _hash(F.col("block"), bits=hash_bits))
        rows = rows.drop("blocks").join(_named(exploded, ranks, ["block"]), "row")
        rows = kept.keep(rows, "rows")
    level, done = 0, []
    while True:
        last = F.col("names")[0]
        done.append(rows.where(F.size("names") == 1).select(
            "doc_id", "text_sha256", F.lit(level).alias("level"), last["h"].alias("h"), last["r"].alias("r")))
        rows = rows.where(F.size("names") > 1)
        if rows.isEmpty():
            break
        rows, level = _pair_level(rows, kept, hash_bits), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _blocks_of(text: str, block_chars: int) -> Column:
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(blocks)


def _pair_level(rows: DataFrame, kept: Staged, hash_bits: int) -> DataFrame:
    """Name adjacent pairs of names; an odd last name pairs with nothing."""
    pairs = F.expr(
        "transform(sequence(0, size(names) - 1, 2), i -> named_struct('a', names[i], 'b', get(names, i + 1)))"
    )
    paired = kept.keep(rows.select("doc_id", "row", "text_sha256", pairs.alias("pairs")), "pairs")
    one = paired.select("row", F.posexplode("pairs").alias("pos", "p")).select(
        "row", "pos", _hash(F.col("p.a.h"), F.col("p.a.r"), F.coalesce("p.b.h", F.lit(0)), F.coalesce("p.b.r", F.lit(-1)), bits=hash_bits).alias("h"),
        F.col("p.a").alias("a"), F.col("p.b").alias("b"),
    )
    ranks = _ranks(one.select("h", "a", "b").distinct(), ["a", "b"], kept)
    if ranks is None:
        names = F.transform("pairs", lambda p: F.struct(
            _hash(p["a"]["h"], p["a"]["r"], F.coalesce(p["b"]["h"], F.lit(0)), F.coalesce(p["b"]["r"], F.lit(-1)), bits=hash_bits).alias("h"),
            F.lit(0).cast("int").alias("r")))
        return kept.keep(paired.select("doc_id", "row", "text_sha256", names.alias("names")), "names")
    return kept.keep(paired.drop("pairs").join(_named(one, ranks, ["a", "b"]), "row"), "names")


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are one group; an empty table gives an empty
    table.  Rows that repeat a doc_id are counted and returned one by one; of a
    group all rows with the smallest id are kept.  Null ids stay only where the
    whole group has none.  Other columns are not read.
    """
    kept = Staged(docs.sparkSession, "exact")
    named = kept.keep(identities(docs, kept, block_chars, hash_bits), "identity")
    key = ["level", "h", "r"]
    groups = kept.keep(named.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
