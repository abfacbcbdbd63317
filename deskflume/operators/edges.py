"""Edges between the datasets of a catalogue: declared keys, shared entities, names, spans, values.

Values of fields become salted MinHash signatures; datasets that share the key of a band are compared
field by field, on signatures alone. Pairs are of catalogue entries, far fewer than rows; the values,
which grow with the data, are made distinct and then reduced to one signature a field in each task.
"""

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import interval_overlap, name_affinity

PERMUTATIONS, BANDS = 128, 16
#: Weights of shared entities by rarity; edges below LEAST are not kept.
RARITY = {"rare": 1.0, "uncommon": 0.6, "common": 0.3}
LEAST = 0.1


def constants(i: int) -> tuple[int, int, int, int]:
    """Two odd factors and two summands of permutation ``i``, of 32 bits each."""
    a, b, c, d = struct.unpack(">4I", hashlib.sha256(f"perm:{i}".encode()).digest()[:16])
    return a | 1, b | 1, c, d


def field_values(rows: DataFrame, dataset: Column, **fields: Column) -> DataFrame:
    """(dataset, field, value): one row for each row and field that has a value, as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()])
    return rows.select(dataset.cast("string").alias("dataset"), F.inline(pairs)).where("dataset IS NOT NULL AND value IS NOT NULL")


def _least(batches):
    a, b, c, d = (np.array(x, np.uint32)[:, None] for x in zip(*map(constants, range(PERMUTATIONS)), strict=True))
    for rows in batches:
        if rows.empty:
            continue
        rows = rows.sort_values(["dataset", "field"], ignore_index=True)
        lo, hi = (rows[x].to_numpy(np.int64).astype(np.uint32) for x in ("lo", "hi"))
        x = lo * a + hi * b + c  # 32-bit arrays, which wrap
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        x = (x ^ (x >> np.uint32(16))) + d
        first = np.flatnonzero(~rows.duplicated(["dataset", "field"]).to_numpy())
        sig = np.minimum.reduceat(x, first, axis=1).T.astype(np.int64)
        sizes = np.diff(np.append(first, len(rows)))
        yield pd.DataFrame({"dataset": rows["dataset"][first].to_numpy(), "field": rows["field"][first].to_numpy(), "n": sizes, "sig": list(sig)})


def signatures(values: DataFrame, salt: str) -> DataFrame:
    """(dataset, field, n, sig): distinct values and the least hash under each permutation."""
    digest = F.sha2(F.concat(F.lit(salt + "\0"), "value"), 256)
    lanes = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(x) for x, at in (("lo", 1), ("hi", 9))]
    parts = values.distinct().select("dataset", "field", *lanes).mapInPandas(_least, "dataset string, field string, n long, sig array<long>")
    rows = parts.groupBy("dataset", "field").agg(F.sum("n").alias("n"), *[F.min(F.get("sig", F.lit(i))).alias(f"s{i}") for i in range(PERMUTATIONS)])
    return rows.select("dataset", "field", "n", F.array(*[f"s{i}" for i in range(PERMUTATIONS)]).alias("sig"))


def bands(sigs: DataFrame) -> DataFrame:
    """(dataset, field, band, key): the first 16 hex digits of each band's SHA-1."""
    width = PERMUTATIONS // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(F.sha1(F.concat_ws(",", F.slice("sig", b * width + 1, width).cast("array<string>"))), 1, 16))
    return sigs.select("dataset", "field", F.posexplode(keys).alias("band", "key"))


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b): datasets that share the key of a band, a < b."""
    own = banded.select("dataset", "key").distinct()
    a, b = (own.withColumnRenamed("dataset", x) for x in "ab")
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def containments(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, fa, fb, jaccard, a_in_b, b_in_a) of all fields of the pairs: the share of equal rows, and
    what it says, by the sizes, about how much of each set is in the other."""
    x, y = (sigs.select(F.col("dataset").alias(d), F.col("field").alias(f"f{d}"), F.col("n").alias(f"n{d}"), F.col("sig").alias(f"s{d}")) for d in "ab")
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda e: e))
    rows = pairs.join(x, "a").join(y, "b").withColumn("jaccard", equal / PERMUTATIONS)
    shared = F.col("jaccard") * (F.col("na") + F.col("nb")) / (1 + F.col("jaccard"))
    return rows.select("a", "b", "fa", "fb", "jaccard", F.least(shared / F.col("na"), F.lit(1.0)).alias("a_in_b"), F.least(shared / F.col("nb"), F.lit(1.0)).alias("b_in_a"))


def value_edges(contained: DataFrame, sigs: DataFrame) -> DataFrame:
    """NEAR_DUPLICATE: .9 x the lesser containment x the likeness of the field names, both above .9.
    SHARED_VALUES: .85 x the greater containment."""
    names = sigs.groupBy("dataset").agg(F.collect_set("field").alias("names"))
    x, y = (names.withColumnsRenamed({"dataset": d, "names": f"names_{d}"}) for d in "ab")
    alike = F.size(F.array_intersect("names_a", "names_b")) / F.size(F.array_union("names_a", "names_b"))
    lesser, greater = F.least("a_in_b", "b_in_a"), F.greatest("a_in_b", "b_in_a")
    best = contained.groupBy("a", "b").agg(F.max(F.when(lesser > 0.9, lesser)).alias("both"), F.max(greater).alias("one"))
    both = best.join(x, "a").join(y, "b").where("both IS NOT NULL").withColumn("alike", alike).where("alike > 0.9")
    return _edge(both, "NEAR_DUPLICATE", 0.9 * F.col("both") * F.col("alike")).union(_edge(best, "SHARED_VALUES", 0.85 * F.col("one")))


def _edge(pairs: DataFrame, kind: str, weight: Column) -> DataFrame:
    return pairs.select("a", "b", F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))


def entity_edges(entities: DataFrame, datasets: Column | int) -> DataFrame:
    """.6 x the rarity of the rarest entity (dataset, entity) that both have."""
    own = entities.distinct()
    df = own.groupBy("entity").agg(F.count("*").alias("df")).where("df > 1")
    share = F.col("df") / datasets
    weight = F.when(share <= 0.05, RARITY["rare"]).when(share <= 0.25, RARITY["uncommon"]).otherwise(RARITY["common"])
    rated = own.join(df.select("entity", (0.6 * weight).alias("w")), "entity")
    a, b = rated.withColumnRenamed("dataset", "a"), rated.drop("w").withColumnRenamed("dataset", "b")
    return _edge(a.join(b, "entity").where("a < b").groupBy("a", "b").agg(F.max("w").alias("w")), "SHARED_ENTITY", F.col("w"))


def name_edges(names: DataFrame) -> DataFrame:
    """.35 x the Jaro-Winkler likeness of names (dataset, name) that is .9 or more. Such a pair shares half
    of each name's characters at least, so both have one of the first characters of a fixed order, as
    many as all but half and one more: only those meet. Empty names link with nothing."""
    letters = F.filter(F.split(F.lower("name"), ""), lambda c: c != "")
    told = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))
    posted = F.slice(F.sort_array(told, asc=False), F.lit(1), F.floor(F.size(told) / 2).cast("int") + 1)
    own = names.select("dataset", "name", F.explode(posted).alias("token"))
    a, b = (own.withColumnsRenamed({"dataset": x, "name": f"name_{x}"}) for x in "ab")
    pairs = a.join(b, "token").where("a < b").drop("token").distinct()
    return _edge(pairs.withColumn("w", name_affinity(F.col("name_a"), F.col("name_b"))).where("w >= 0.9"), "NAME_AFFINITY", 0.35 * F.col("w"))


def span_edges(spans: DataFrame) -> DataFrame:
    """.2 x shared over whole time of spans (dataset, since, until), which meet in the year in which the later one begins."""
    own = spans.select("dataset", F.unix_micros(F.col("since").cast("timestamp")).alias("t0"), F.unix_micros(F.col("until").cast("timestamp")).alias("t1"), F.year("since").alias("y0"), F.year("until").alias("y1"))
    own = own.where("t0 <= t1").withColumn("year", F.explode(F.sequence("y0", "y1")))
    a, b = (own.select("year", F.col("dataset").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("t0", "t1", "y0")]) for x in "ab")
    pairs = a.join(b, "year").where("a < b AND year = greatest(y0_a, y0_b)")
    return _edge(pairs, "TEMPORAL_ALIGNMENT", 0.2 * interval_overlap(F.col("t0_a"), F.col("t1_a"), F.col("t0_b"), F.col("t1_b")))


def dataset_edges(values: DataFrame, salt: str, names: DataFrame, spans: DataFrame, entities: DataFrame, declared: DataFrame) -> DataFrame:
    """(a, b, kind, weight) of all kinds, one row a pair and kind, weights from LEAST on. ``names`` has one
    row a dataset; ``declared`` (a, b) are foreign keys, which weigh 1."""
    sigs = signatures(values, salt)
    contained = containments(candidates(bands(sigs)), sigs)
    many = names.count()
    every = [_edge(declared.where("a <> b"), "DECLARED_FK", F.lit(1.0)), value_edges(contained, sigs), entity_edges(entities, F.lit(many)), name_edges(names), span_edges(spans)]
    rows = every[0].union(every[1]).union(every[2]).union(every[3]).union(every[4])
    return rows.where(F.col("weight") >= LEAST).groupBy("a", "b", "kind").agg(F.round(F.max("weight"), 6).alias("weight"))
