"""Connected components as a distributed union-find.

Alternating small-star and large-star rounds (Kiveris et al., *Connected
Components in MapReduce and Beyond*, 2014): each round hangs nodes below the
smallest neighbour seen, until every component is a star around its smallest
node.  Rounds are logarithmic in practice.

An edge (u, v) has v < u.  The small star of u joins its smaller neighbours to
the smallest of them.  The large star replaces v by *its* smallest neighbour in
every edge (u, v); nodes without a smaller neighbour keep their edges, so a
centre with millions of edges takes part as the wide side of a join only, whose
two sides are stored tables and which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged


def components(edges: DataFrame, kept: Staged) -> DataFrame:
    """(node, root) of every node with an edge; root is its component's smallest node.

    ``edges`` has two columns of one orderable type.  Self-loops, repeats and
    null ends are ignored; an empty table gives an empty result.
    """
    a, b = edges.columns
    cores = edges.sparkSession.sparkContext.defaultParallelism
    keep = lambda df, name: kept.keep(df.coalesce(cores), name)  # noqa: E731  one wave of tasks: the tables are small
    fine = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = keep(edges.where(fine).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    going = not edges.isEmpty()
    while going:
        least = F.min("v").over(Window.partitionBy("u"))
        small = edges.withColumn("m", least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = keep(small.select("e.*").where("u <> v").distinct(), "small")
        below = keep(small.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "below")
        large = small.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        large = keep(large.groupBy("u", "v").agg(F.max("moved").alias("moved")), "large")
        kept.drop(edges, small, below)
        edges = large.select("u", "v")
        kept.adopt(edges, large)
        state = large.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
        going = state.moved or state.n > state.nodes
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
