"""Connected components of links by large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task holds at least, where there are as many: few links make few tasks and files.
EDGES_PER_TASK = 200_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of the links (a, b): comp is the component's least node.

    Each round points nodes at lesser neighbours; rounds grow with the logarithm of a component's width. Edges
    are cut to the checkpoint folder between rounds; tasks between the shuffles of a round are as many as the edges ask for. A node with very many links is a row for each link, dealt by a
    join whose sides Spark can split.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark, n = None, edges.count()
    for _ in range(most_rounds):
        tasks = max(1, -(-2 * n // EDGES_PER_TASK))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")).coalesce(tasks))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(tasks).distinct()
        # large-star leaves a node few lesser neighbours
        small = large.coalesce(tasks).withColumn("m", F.min("v").over(Window.partitionBy("u")))
        stars = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.select(F.explode(stars).alias("e")).select("e.*").where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            break
        mark, n = tuple(now), now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops).distinct()
