"""Operator 11: a Merkle manifest of a dataset, with one proof a row.

Every row is a leaf; the leaves of a group (language) stand in order of their ids, and every
``fanout`` consecutive nodes become one parent, level by level, until one subroot is left. The
subroots, in order of their groups, give the root in the same way.

Leaves get row numbers over the whole group without a window over it: rows are sorted by range, and a
row's number is its place in its partition behind the rows that earlier partitions have of the group.
Levels are DataFrames: row numbers are floor-divided, the sorted array of children is grouped, and
hashing it gives the parents. ``STEP`` levels are taken at once: a group holds the fanout ** STEP nodes below
one node, and the levels between are hashed inside its row. So 10^11 rows of fanout 2 take five
rounds. Proofs then go down again: each round joins nodes with the proof of the node above and puts
the siblings before it, so all rounds together move each node once, not every row at every level.

Scale: no group is larger than fanout ** STEP nodes, however many rows a language has; the table of
offsets has at most a row for each partition and each group. Each round is a stored table.

Values: H is the lower-case hex SHA-256 of its inputs one after another. A leaf is H of the columns,
each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. A run with one node has a parent
too, while the level has other nodes; a group of one leaf has it as subroot.

Defined results: nulls hash as above; a null group is a group and comes first; null ids come first
in their group; rows of one id are ordered by their leaves and repeated rows are leaves each; texts
are hashed whole; columns that are not named take no part; an empty table gives no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_folder, stored

#: Levels that are hashed inside one group.
STEP = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, values)))


def numbered(rows: DataFrame, group: str, order: list[str], folder: str, name: str) -> DataFrame:
    """``rows``, a stored table, with ``i``, their number from 0 in their group by ``order``, and ``n``, the group's rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [group, *order, "tie"]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt.drop("tie").withColumn("part", F.shiftright("at", 33)), folder, f"{name}-dealt")
    own = dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    offsets = own.select(group, "part", (F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return dealt.join(offsets, [group, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def depth(n: Column, fanout: int) -> Column:
    """Levels above n nodes until one is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fanout)), k) < n))


def _levels(nodes: Column, count: Column, fanout: int) -> Column:
    """[nodes, parents, ...]: ``count`` levels above an array of hashes, all in one array."""

    def parents(x):
        runs = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda k: digest(F.array_join(F.slice(x, k * fanout + 1, F.lit(fanout)), "")))

    rounds = F.slice(F.array(*[F.lit(k) for k in range(STEP)]), 1, count)
    return F.aggregate(rounds, F.array(nodes), lambda all_, _: F.concat(all_, F.array(parents(F.element_at(all_, -1)))))


def _siblings(levels: Column, i: Column, count: Column, fanout: int) -> Column:
    """For node i of the lowest level, at each level: its place in its run and the run's others."""

    def at(k):
        own = F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")
        place = F.pmod(own, F.lit(fanout))
        run = F.slice(levels[k], own - place + 1, F.lit(fanout))
        return F.struct(place.alias("place"), F.concat(F.slice(run, F.lit(1), place), F.slice(run, place + 2, F.lit(fanout))).alias("others"))

    return F.transform(F.slice(F.array(*[F.lit(k) for k in range(STEP)]), 1, count), at)


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.transform(F.array(value), body)[0]


def trees(nodes: DataFrame, group: str, fanout: int, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """nodes: group, i, n, hash, carry. Returns (group, subroot), and (group, carry, subroot, proof), proof from the leaf up."""
    block = fanout**STEP
    left = nodes.select(group, "i", depth(F.col("n"), fanout).alias("left"), F.struct((F.col("i") % block).cast("int").alias("place"), "hash", "carry").alias("node"))
    rounds, tables = None, []
    while rounds is None or len(tables) < rounds:
        grouped = left.groupBy(group, F.floor(F.col("i") / block).alias("i"), "left").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        table = stored(grouped.withColumn("count", F.least("left", F.lit(STEP))), folder, f"{name}-{len(tables)}")
        tables.append(table)
        if rounds is None:
            most = table.agg(F.max("left")).first()[0] or 0
            rounds = max(1, -(-most // STEP))
        levels = _levels(F.col("nodes.hash"), F.col("count"), fanout)
        top = table.select(group, "i", "left", "count", F.element_at(levels, -1)[0].alias("hash"))
        left = top.select(group, "i", (F.col("left") - F.col("count")).alias("left"), F.struct((F.col("i") % block).cast("int").alias("place"), "hash", F.lit(None).cast("int").alias("carry")).alias("node"))
    subroots = left.select(group, F.col("node.hash").alias("subroot"))

    above = subroots.select(group, F.lit(0).cast("long").alias("i"), "subroot", F.array().cast("array<struct<place:int,others:array<string>>>").alias("proof"))
    for k in reversed(range(len(tables))):
        table = tables[k].join(above, [group, "i"])
        own = _let(_levels(F.col("nodes.hash"), F.col("count"), fanout), lambda ls: F.transform("nodes", lambda x: F.struct(x["place"].alias("place"), x["carry"].alias("carry"), _siblings(ls, x["place"], F.col("count"), fanout).alias("own"))))
        down = table.select(group, "i", "subroot", "proof", F.explode(own).alias("x"))
        above = down.select(group, (F.col("i") * block + F.col("x.place")).alias("i"), F.col("x.carry").alias("carry"), "subroot", F.concat("x.own", "proof").alias("proof"))
        if k:
            above = stored(above.drop("carry"), folder, f"{name}-down-{k}")
    return subroots, above.drop("i")


def manifest(docs: DataFrame, group="lang", doc_id="doc_id", columns=LEAF_COLUMNS, fanout=2, carry: Column | None = None) -> DataFrame:
    """One row a leaf: id, leaf, subroot, root, proof (from the leaf up: its place in its run and the
    run's others), and ``carry``, a column of what else is wanted of a row."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(encoded(F.col(group)).alias("key"), F.col(group).cast("string").alias("group"), F.col(doc_id).alias("id"), leaf([F.col(c) for c in columns]).alias("hash"), (F.lit(None).cast("int") if carry is None else carry).alias("carry"))
    leaves = numbered(stored(rows, folder, "leaves"), "key", ["id", "hash"], folder, "rows")
    nodes = leaves.select("key", "i", "n", "hash", F.struct("group", "id", F.col("hash").alias("leaf"), "carry").alias("carry"))
    subroots, proofs = trees(nodes, "key", fanout, folder, "leaf")
    subroots = stored(subroots, folder, "subroots")
    names = stored(leaves.groupBy("key").agg(F.first("group").alias("group")).join(subroots, "key").select(F.lit(0).alias("one"), "key", "group", F.col("subroot").alias("hash")), folder, "groups")
    above = numbered(names, "one", ["group"], folder, "groups")
    root, tops = trees(above.select("one", "i", "n", "hash", F.col("key").alias("carry")), "one", fanout, folder, "group")
    tops = stored(tops.select(F.col("carry").alias("key"), F.col("subroot").alias("root"), F.col("proof").alias("upper")), folder, "tops")
    return proofs.join(tops, "key").select("carry.id", "carry.leaf", F.col("carry.carry").alias("carry"), "subroot", "root", F.concat("proof", "upper").alias("proof"))


def folded(start: Column, proof: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(F.array_join(F.slice(s["others"], F.lit(1), s["place"]), ""), h, F.array_join(F.slice(s["others"], s["place"] + 1, F.greatest(F.size(s["others"]), F.lit(1))), ""))))


def op11(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    values = [F.col(c) + F.when(tampered, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    carry = F.when(tampered, leaf(values))
    out = manifest(docs, carry=carry)
    start = F.coalesce("carry", "leaf")
    siblings = F.array_join(F.flatten(F.col("proof.others")), "")
    shown = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(start, F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by DuckDB.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')],
    lambda r, c: list_reduce([xor(r, c)] || [j::BIGINT for j in range(8)], lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS c FROM documents),
e AS (
  SELECT doc_id, lang, coalesce(xor(c, 4294967295::BIGINT) % 7 = 0, false) AS tampered, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM d),
f AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other FROM e),
leaves AS (SELECT *, coalesce('+' || lang, '-') AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
t(k, key, i, h, n) AS (
  SELECT 0, key, i, leaf, n FROM leaves
  UNION ALL
  SELECT k + 1, key, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM t WHERE n > 1 GROUP BY k, key, i // 2),
s AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key <> '-', key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(k, i, h, n) AS (
  SELECT 0, i, subroot, n FROM s
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM u WHERE n > 1 GROUP BY k, i // 2),
steps AS (
  SELECT l.doc_id, l.key, l.i AS leaf_i, t.k AS k, a.h AS other, (l.i >> t.k) % 2 AS place
  FROM leaves l JOIN (SELECT DISTINCT key, k FROM t WHERE n > 1) t ON t.key = l.key LEFT JOIN t a ON a.key = l.key AND a.k = t.k AND a.i = xor(l.i >> t.k, 1)
  UNION ALL
  SELECT l.doc_id, l.key, l.i, 1000 + u.k, a.h, (s.i >> u.k) % 2
  FROM leaves l JOIN s ON s.key = l.key CROSS JOIN (SELECT DISTINCT k FROM u WHERE n > 1) u LEFT JOIN u a ON a.k = u.k AND a.i = xor(s.i >> u.k, 1)),
proofs AS (SELECT key, leaf_i, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof_sha256, list({'o': coalesce(other, ''), 'p': place} ORDER BY k) AS path FROM steps GROUP BY key, leaf_i),
folds AS (
  SELECT l.*, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce([{'o': coalesce(l.other, l.leaf), 'p': 0::BIGINT}] || coalesce(p.path, []), lambda a, b: {'o': sha256(CASE WHEN b.p = 0 THEN a.o || b.o ELSE b.o || a.o END), 'p': 0::BIGINT}).o AS folded_root
  FROM leaves l LEFT JOIN proofs p ON p.key = l.key AND p.leaf_i = l.i)
SELECT f.doc_id, f.leaf, s.subroot, r.h AS root, f.proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM folds f JOIN s ON s.key = f.key CROSS JOIN (SELECT h FROM u WHERE n = 1) r
"""
