"""Connected components by minimum-label propagation with pointer jumping.

Each round is a few equi-joins and partially aggregated minima, so a vertex with very many
neighbours is never gathered; lineage is cut by a stored table each round. Edges that come as
stars around group centres need a handful of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b): label is the smallest vertex reachable."""
    both = stored(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).where("v <> u").distinct(), folder, f"{name}-edges")
    labels = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), folder, f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label").select("v", "old", F.least("label", "far").alias("label"))
        labels = stored(step, folder, f"{name}-{k}")
        if labels.where("label < old").isEmpty():
            return labels.select("v", "label")
        labels = labels.select("v", "label")
