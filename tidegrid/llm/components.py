"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import pin


def _join_key(column: str):
    """A number that joins as the column does, but is not what an aggregation before was dealt by: the planner
    deals both sides anew and can split what a hot key fills."""
    return F.col(column).bitwiseXOR(F.lit(1).cast("long"))


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m) with m the smallest of u and its partners in pairs(u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(_join_key("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.where("v > u").withColumn("k", _join_key("u")).join(_smallest(both), "k")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them. Edges have u > v."""
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    small = low.groupBy("u").agg(F.min("v").alias("m")).select(_join_key("u").alias("k"), "m")
    tied = low.withColumn("k", _join_key("u")).join(small, "k").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = small.select(_join_key("k").alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v").unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u long, v long); root is the smallest node of its component.

    Self-loops and repeated edges are allowed, nulls are dropped. Every round checkpoints the edges in the
    shared folder; the number of rounds is logarithmic in the longest path.
    """
    nodes = edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long"))
    ties = nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    ties = pin(ties)
    state = _digest(ties)
    while True:
        ties = pin(_small_star(_large_star(ties)))
        now = _digest(ties)
        if now == state:
            break
        state = now
    loops = nodes.where("u = v").select(F.col("u").alias("node")).distinct()
    found = ties.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    found = found.unionByName(roots)
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti").withColumn("root", F.col("node")))


def _digest(ties: DataFrame):
    return tuple(ties.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
