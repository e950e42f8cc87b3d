"""Connected components of a graph too large for any one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import stage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = _least_neighbour(down)
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for each node of ``pairs`` (a, b).

    Large and small stars in turn until nothing changes; each round is written to the shared
    folder, which cuts the lineage. Rows stay at most the number of links, and least neighbours
    are pre-aggregated, so a hub is no hot group.
    """
    edges = stage(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "pairs")
    edges = stage(_small_star(edges), "links")
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """A round that ties nothing anew leaves the same set of links: count and checksum of it."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    ).first()
    return row["n"], row["mark"]
