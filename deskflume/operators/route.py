"""Routing: which sources answer a question best, by content, duplicates and the graph around them.

A first score comes from a source's best chunk (never a sum) and from how many sections match. A second
pass marks sources that a near duplicate beats. Then the graph adds what sources with a signal, and
beaten ones, carry to their neighbours in two hops at most, inside what the reader may read.

Scale: a walk must not come back to the source it began at, so its beginnings have to be known. Of all
that reach a node only the best two beginnings matter to the next hop (one of them is not the next
node), so two rows a node are carried on and no set of walks is ever expanded. Members of one group
reach each other without pairs: three members with a signal stand for all of them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways

#: Weights of the score, the share of a hop, what each kind of edge carries on, and siblings do.
VECTOR, KEYWORD, SECTION, SECTIONS, GRAPH, DUPLICATE = 0.5, 0.5, 0.05, 3, 0.20, 0.50
FLOOR = 0.15
HOP = 0.6
FACTORS = {"DECLARED_FK": 0.90, "SHARED_VALUES": 0.80, "SHARED_ENTITY": 1.00, "SHARED_KEYWORD": 0.50, "SAME_COLLECTION": 0.40}
TEMPORAL = "TEMPORAL_ALIGNMENT"
SIBLING = 0.30


def content(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, lex, vec, alt, entity_hit, pre0) of every source; chunks that match: doc, section, lex, vec, entity."""
    per = chunks.groupBy(F.col("doc").alias("id")).agg(
        F.max("lex").alias("lex"), F.max("vec").alias("vec"), F.count_distinct(F.when(F.col("lex") >= FLOOR, F.col("section"))).alias("alt"), F.bool_or("entity").alias("entity_hit")
    )
    rows = sources.select("id").join(per, "id", "left").withColumn("alt", F.coalesce("alt", F.lit(0)))
    zero = F.lit(0.0)
    return rows.withColumn("pre0", VECTOR * F.coalesce("vec", zero) + KEYWORD * F.coalesce("lex", zero) + SECTION * F.least("alt", F.lit(SECTIONS)))


def outscored(scored: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``scored`` with dup: whether a near duplicate (a, b) has a higher score, or the same and a smaller id."""
    pairs = duplicates.select("a", "b").union(duplicates.select("b", "a"))
    peer = scored.select(F.col("id").alias("b"), F.struct("pre0", (-F.col("id")).alias("minus")).alias("peer"))
    best = pairs.join(peer, "b").groupBy(F.col("a").alias("id")).agg(F.max("peer").alias("peer"))
    return scored.join(best, "id", "left").withColumn("dup", F.coalesce(F.col("peer") > F.struct("pre0", (-F.col("id")).alias("minus")), F.lit(False))).drop("peer")


def _first(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n).drop("place")


def _two_best(rows: DataFrame) -> DataFrame:
    """Of (seed, node, carried), the two seeds that carry most to each node."""
    return _first(rows.groupBy("node", "seed").agg(F.max("carried").alias("carried")), "node", [F.desc("carried"), F.asc("seed")], 2)


def siblings(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, node, carried) of members (id, source) of a seed's source: at most three seeds for each node."""
    own = members.join(seeds, "id").select("source", F.col("id").alias("seed")).distinct()
    some = _first(own, "source", [F.asc("seed")], 3)
    return members.join(some, "source").where("id <> seed").select("seed", F.col("id").alias("node"), F.lit(SIBLING).alias("carried"))


def around(seeds: DataFrame, edges: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, graph): the most that any seed carries to a node over its siblings and edges (a, b, kind,
    weight), HOP for each of two hops at most."""
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv]), F.col("kind")), F.lit(0.0))
    times = F.when(F.col("kind") == TEMPORAL, 1 + F.col("weight")).otherwise(F.col("weight") * factor)
    ways = both_ways(edges.where("weight > 0 AND a <> b").select("a", "b", times.alias("weight")))
    ways = ways.join(ids.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    start = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1.0).alias("carried"))

    def step(at):
        return at.join(ways, F.col("node") == F.col("a")).where("b <> seed").select("seed", F.col("b").alias("node"), (F.col("carried") * F.col("weight")).alias("carried"))

    near = _two_best(step(start).union(siblings(seeds, members.join(ids, "id", "left_semi"))))
    both = near.select("node", (F.col("carried") * HOP).alias("graph")).union(step(near).select("node", (F.col("carried") * HOP**2).alias("graph")))
    return both.groupBy(F.col("node").alias("id")).agg(F.max("graph").alias("graph"))


def route(sources: DataFrame, chunks: DataFrame, edges: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """(id, score, pre, entity_hit, graph, alt, dup, entitled): the first ``k`` (at most 25) of the sources that
    may be read: those with an entity of the question first, then by score, then by id."""
    marked = outscored(content(sources, chunks), edges.where("kind = 'NEAR_DUPLICATE'"))
    seeds = marked.where("coalesce(lex, 0) > 0 OR entity_hit OR dup").select("id")
    graph = around(seeds, edges.where("kind <> 'NEAR_DUPLICATE'"), members, sources.select("id"))
    zero = F.lit(0.0)
    rows = marked.join(graph, "id", "left").withColumn("graph", F.coalesce("graph", zero))
    rows = rows.withColumn("pre", F.col("pre0") + GRAPH * F.col("graph")).withColumn("score", F.col("pre") - F.when(F.col("dup"), DUPLICATE).otherwise(0.0))
    shown = rows.select("id", *[F.round(c, 6).alias(c) for c in ("score", "pre", "graph")], F.coalesce("entity_hit", F.lit(False)).alias("entity_hit"), "alt", "dup")
    total = sources.agg(F.count("*").alias("entitled"))
    return shown.orderBy(F.desc("entity_hit"), F.desc("score"), "id").limit(min(max(k, 1), 25)).join(F.broadcast(total))  # one row
