"""Operator 11 — a Merkle manifest of a dataset by slot pivots.

A row's leaf is the SHA-256 of its fields.  Per group (language) the leaves
stand in order of their id; runs of ``fanout`` nodes become one parent until
one node, the group's subroot, is left.  The subroots, in order of the group's
name, make the tree on top in the same way.

A level is one pivot: ``groupBy(parent)`` with a conditional aggregate per slot
spreads a parent's children into ``fanout`` columns.  Concatenated, the columns
hash to the parent; without a child's own column they are its siblings, which
stand to the left and to the right of it.

Scale: text is hashed in the scan and never moves.  Positions come from a range
exchange with one offset per partition, so no task sees a whole group.  Nodes
are dealt out in blocks of up to ``BLOCK`` neighbours; all levels inside a block
are pivoted without a further exchange, so ten levels cost one shuffle, and a
corpus of 10^12 rows needs four.  On the way down a block gets the path above
it by one join of stored tables, a thousandth of the rows against the rows; the
keys are block numbers, so a hot language is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

#: Children of a node, leaves of a block (at most), and one row in this many is tampered with.
FANOUT, BLOCK, TAMPER = 2, 1024, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEPS = "array<struct<left:string,right:string>>"


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs one after another."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """A field's part of the leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None, fields: list[str] = FIELDS) -> Column:
    """The leaf of a row; ``changed`` replaces columns by other values."""
    return digest(*[field((changed or {}).get(c, F.col(c))) for c in fields])


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(steps, F.lit(""), lambda text, s: F.concat(text, s["left"], s["right"])), 256)


def numbered(rows: DataFrame, keys: list[Column], name: str, kept: Staged) -> DataFrame:
    """``rows`` with ``serial``, 0 for the first by ``keys``: sorted ranges, then one offset per partition."""
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = kept.keep(ranges.withColumn("at", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    totals = stored.groupBy(part.alias("part")).agg(F.count("*").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = kept.keep(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), f"{name}-base")
    placed = stored.join(F.broadcast(base), part == base["part"])
    return placed.withColumn("serial", F.col("base") + within).drop("part", "base", "at")


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level inside the blocks: (g, block, pos, n, digest, members) of the parents.

    ``n`` counts the group's nodes on this level; a group with one node left
    passes through unchanged.
    """
    slot = F.pmod("pos", F.lit(fanout))
    slots = range(fanout)
    spread = nodes.groupBy("g", "block", F.expr(f"pos div {fanout}").alias("pos")).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(slot == j, F.col("digest"))).alias(f"s{j}") for j in slots],
        *[F.any_value(F.when(slot == j, F.col("members")), F.lit(True)).alias(f"m{j}") for j in slots],
    )
    child = [F.coalesce(f"s{j}", F.lit("")) for j in slots]
    side = lambda some: F.concat(*some) if some else F.lit("")
    nothing = F.slice("m0", 1, 0)

    def climbed(j: int) -> Column:
        step = F.struct(side(child[:j]).alias("left"), side(child[j + 1 :]).alias("right"))
        return F.transform(F.coalesce(f"m{j}", nothing), lambda x: F.struct(x["m"].alias("m"), F.concat(x["steps"], F.array(step)).alias("steps")))

    going = F.col("n") > 1
    return spread.select(
        "g", "block", "pos", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
        F.when(going, digest(*child)).otherwise(F.col("s0")).alias("digest"),
        F.when(going, F.concat(*[climbed(j) for j in slots])).otherwise(F.col("m0")).alias("members"),
    )


def build(nodes: DataFrame, kept: Staged, fanout: int = FANOUT, block: int = BLOCK) -> list[DataFrame]:
    """Rounds of levels over ``nodes`` (g, pos, n, digest, m), stored one by one.

    A round has a row per block: (g, block, n, digest, members), with the steps
    of each member up to the block's top.  The last one has a row per group.
    """
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    rounds: list[DataFrame] = []
    while True:
        own = F.array(F.struct("m", F.array().cast(_STEPS).alias("steps")))
        cur = nodes.select("g", F.expr(f"pos div {fanout**levels}").alias("block"), "pos", "n", "digest", own.alias("members"))
        cur = cur.repartition("g", "block")
        for _ in range(levels):
            cur = _pivot(cur, fanout)
        rounds.append(kept.keep(cur.drop("pos"), f"round-{len(rounds)}"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return rounds
        nodes = rounds[-1].select("g", F.col("block").alias("pos"), "n", "digest", F.struct("block").alias("m"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, m, steps, …) of every member of the first round: its steps up to the group's top, then those of
    ``above`` (g, steps, …), which has a row per group."""
    up = above.withColumn("block", F.lit(0).cast("long"))
    carried = [c for c in above.columns if c not in ("g", "steps")]
    for k, stored in reversed(list(enumerate(rounds))):
        higher = up.select("g", "block", F.col("steps").alias("higher"), *carried)
        each = stored.select("g", "block", "members").join(higher, ["g", "block"]).select("g", "higher", *carried, F.explode("members").alias("x"))
        steps = F.concat("x.steps", "higher").alias("steps")
        up = each.select("g", F.col("x.m").alias("m") if k == 0 else F.col("x.m.block").alias("block"), steps, *carried)
    return up


def manifest(docs: DataFrame, payload: dict[str, Column] | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, the ``payload`` columns, steps, subroot, root.

    ``steps`` is the row's proof: per level the siblings to the left and to the
    right, digests concatenated.  ``payload`` is evaluated on the rows of
    ``docs``.  Null ids come first in their group, rows with the same id stand
    in order of their leaves, a null language is a group of its own and the
    first.  One row alone is its own root with an empty proof; an empty table
    gives an empty table.  Only the fields of the leaf are read.
    """
    kept = Staged(docs.sparkSession, "merkle")
    payload = payload or {}
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf().alias("leaf"), *[c.alias(k) for k, c in payload.items()])
    leaves = kept.keep(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # spreads rows that are alike
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    leaves = kept.keep(numbered(leaves, order, "sorted", kept), "serial")
    groups = leaves.groupBy("lang").agg(F.min("serial").alias("first"), F.count("*").alias("n"))
    groups = kept.keep(numbered(kept.keep(groups, "groups"), [F.asc_nulls_first("lang")], "groups-sorted", kept).withColumnRenamed("serial", "g"), "groups-serial")
    placed = leaves.join(groups.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    nodes = placed.select("g", (F.col("serial") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", *payload).alias("m"))
    rounds = build(nodes, kept, fanout, block)
    one = [F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(groups.count()).alias("n"), "digest", F.struct("g", "digest").alias("m")]
    top = build(kept.keep(rounds[-1].select(*one), "subroots"), kept, fanout, block)  # stored: a literal isn't a key to deal by
    none = F.array().cast(_STEPS).alias("steps")
    over = paths(top, top[-1].select("g", none, F.col("digest").alias("root")))
    over = kept.keep(over.select("m.g", "steps", F.col("m.digest").alias("subroot"), "root"), "over")
    return paths(rounds, over).select("m.*", "steps", "subroot", "root")


def tampered(fields: list[str] = FIELDS, every: int = TAMPER) -> Column:
    """The leaf after tampering: where ``every`` divides the CRC-32 of the decimal id, n_chars is one more."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return F.when(hit, leaf({"n_chars": more}, fields))


def verify(proofs: DataFrame, presented: str = "tampered") -> DataFrame:
    """``proofs`` with folded_root, from the ``presented`` leaf where there is one, and verified."""
    folded = fold(F.coalesce(presented, F.col("leaf")), F.col("steps"))
    return proofs.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
