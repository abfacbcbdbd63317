"""Two-hop graph scores over undirected edges, with entitlement inside every hop."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.6


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b, weight) in both directions, so that hops are equi-joins."""
    return edges.union(edges.select("b", "a", "weight"))


def related(edges: DataFrame, ids: DataFrame, node: int, k: int) -> DataFrame:
    """The heaviest neighbours of a node among the readable ids; ties by id."""
    near = both_ways(edges).where((F.col("a") == node) & (F.col("weight") > 0)).select(F.col("b").alias("id"), "weight")
    return near.join(ids, "id", "left_semi").groupBy("id").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "id").limit(k)


def two_hops(seeds: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, graph): the best product of edge weights from any seed times DECAY for each hop, at most 2."""
    steps = both_ways(edges).where("weight > 0").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    at = seeds.select(F.col("id").alias("a"), F.lit(1.0).alias("carried"))
    found = []
    for hop in (1, 2):
        at = steps.join(at, "a").groupBy(F.col("b").alias("a")).agg(F.max(F.col("weight") * F.col("carried")).alias("carried"))
        found.append(at.select(F.col("a").alias("id"), (F.col("carried") * DECAY**hop).alias("graph")))
    return found[0].union(found[1]).groupBy("id").agg(F.round(F.max("graph"), 6).alias("graph"))
