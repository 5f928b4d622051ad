"""Connected components of a link table, by alternating large and small stars.

Links stay in Spark: each round is two groupings by node and two joins, written
to the shared checkpoint folder. Hot nodes (a star's centre) are summed before
the shuffle, and the joins are those that adaptive execution splits by size.
Rounds work in as many partitions as the edges need, not in those of the session.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import cut

MAX_ROUNDS = 60
#: Edges of a partition: a shuffle writes files for each, however few edges there are.
PART_EDGES = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (a, b)."""
    edges = cut(_ordered(links.select("a", "b")))
    mark = _mark(edges)
    parts = 1 + mark[0] // PART_EDGES
    edges = edges.coalesce(parts)
    for _ in range(MAX_ROUNDS):
        edges = cut(_small_star(_large_star(edges, parts), parts).coalesce(parts))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # Every edge now joins a node to its component.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct().coalesce(parts))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller node first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(edges.withColumnRenamed("a", "u").join(least, "u").select(F.col("m").alias("a"), "b").coalesce(parts)).coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").coalesce(parts)
    return _ordered(moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(moved.select(F.col("m").alias("a"), "b")))
