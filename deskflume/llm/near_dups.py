"""Operator 3: near-duplicates by a signature-coordinate inverted join.

Each document's word shingles give a MinHash signature of ``K`` coordinates. A document is posted
under its coordinate-value pairs; two documents that collide on at least ``MIN_MATCH`` coordinates
are candidates, and links are confirmed on the full shingle sets (100 * common >= 80 * union).

Prefix and skip merging keep the lists short. All coordinate-value pairs are ordered by how many
documents hold them. A document that shares fewer than MIN_MATCH values with anybody is out. Of
the m values that it shares, only the m - MIN_MATCH + 1 rarest are posted: two documents with
MIN_MATCH collisions meet in one of these prefixes, so the long lists at the end are skipped.

No list is expanded into rows of pairs. Members of a list are dealt to the list's centre, the member
that shares most values with others. Groups of a centre are split into chunks; inside a chunk the
coordinates at which members collide are counted, pairs with MIN_MATCH or more of them are compared
exactly, and only a spanning forest of the links leaves the task. In groups of several chunks, members that did not reach the centre's component are then
compared with all other chunks, block by block, so no link between components is lost.

A collision threshold of 38 in 64 misses a pair at similarity 0.8 with a probability of about
4e-5 (binomial), less above. Exact copies (equal shingle sets) are one class from the start.

Defined results: null, empty or blank text has no shingles and links to nothing; fewer words than a
shingle make one shingle of the whole; rows of one doc_id with different texts are documents of
their own (each is linked by its own text; of those that are near copies of each other ``near_dedup``
keeps one); repeated rows of the document that stays all stay; a null doc_id gets a null component and
stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import documents, fresh, joined_by_rows, lean, shared_folder, stored
from .components import connected

K = 64
MIN_MATCH = 38
#: Members of a centre's group that are compared in one task at once.
CHUNK = 256
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 17
#: Shingles of a chunk that are multiplied at once.
COLUMNS = 4096


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def constants(n: int, seed: int, kind) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, np.iinfo(kind).max, n, dtype=kind) | kind(1)


def shingle_hashes(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, ASCII white space."""
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    factors = constants(width, 1, np.uint64)
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ (s >> np.uint64(29))) * factors[j] + h[j : len(h) - n + 1 + j]
    return np.unique((s ^ (s >> np.uint64(32))) * factors[0])


def signature(shingles: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, ((x[i : i + 4096, None] ^ salts) * factors).min(axis=0), out=out)
    return out


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, hash, n, digest, signature) of ``docs`` (id, text, hash)."""

    def run(batches):
        known, salts, factors = _WordHashes(), constants(K, 2, np.uint32), constants(K, 3, np.uint32)
        for b in batches:
            ns, digests, sigs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_hashes(text, width, known)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, salts, factors))
            flat = np.concatenate(sigs).view(np.int32) if sigs else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(ns) + 1, K), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "hash", "n", "digest", "signature"])

    return docs.mapInArrow(lean(run), "id long, hash long, n long, digest binary, signature array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """(rep, token, central, first): the values that each class shares, if at least MIN_MATCH;
    first: whether the value is in the prefix."""
    tokens = classes.select("rep", F.posexplode("signature").alias("i", "x")).select("rep", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("x").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))  # at most K
    own = own.where(F.size("own") >= MIN_MATCH).withColumn("central", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.df))
    return own.select("rep", "central", F.size("own").alias("m"), F.posexplode("own").alias("at", "x")).select("rep", "central", F.col("x.token").alias("token"), (F.col("at") <= F.col("m") - MIN_MATCH).alias("first"))


def memberships(posts: DataFrame) -> DataFrame:
    """(centre, rep): for each class, the centres of the lists in its prefix, and each centre itself."""
    centre = F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("best")
    lists = posts.groupBy("token").agg(centre, F.count_if("first").alias("posted")).where("posted > 1").select("token", (-F.col("best.minus")).alias("centre"))
    found = posts.where("first").join(lists, "token").select("centre", "rep").distinct()
    return found.union(found.select("centre", F.col("centre").alias("rep"))).distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 4:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    sides = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    places = []
    for x, flat in zip((left, right), sides, strict=True):
        row = np.repeat(np.arange(len(x)), [len(s) for s in x])
        col = np.searchsorted(both, flat)
        col[col == len(both)] = 0
        ok = both[col] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(col[ok], kind="stable")
        places.append((row[ok][order], col[ok][order]))
    for lo in range(0, len(both), COLUMNS):
        dense = []
        for x, (row, col) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(col, [lo, lo + COLUMNS])
            m = np.zeros((len(x), min(COLUMNS, len(both) - lo)), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(left, right, percent: int) -> np.ndarray:
    common = common_counts(left, right).astype(np.int64)
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    return (common > 0) & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common))


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """At how many coordinates each left signature has the value of each right one: for each
    coordinate, a list of the right ones under their values; empty ones are skipped."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for k in range(K):
        values, at = np.unique(right[:, k], return_inverse=True)
        place = np.minimum(np.searchsorted(values, left[:, k]), len(values) - 1)
        rows = np.flatnonzero(values[place] == left[:, k])
        out[rows] += at[None, :] == place[rows, None]
    return out


def _forest(ids: np.ndarray, start: np.ndarray, pairs) -> list[tuple[int, int]]:
    """Links that join different parts; ``start``: the part that each id is in already."""
    above: dict[int, int] = {}

    def top(x):
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for i, j in pairs:
        a, b = top(int(start[i])), top(int(start[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(width: int, percent: int):
    """Rows come sorted by group key; columns: key columns..., id, part, outside, text.

    With no member outside, all members of a group are compared; else those outside with the rest.
    """

    salts, factors = constants(K, 2, np.uint32), constants(K, 3, np.uint32)

    def matches(sets, sigs, left, right):
        """Pairs (i of left, j of right) with MIN_MATCH collisions, confirmed on their sets."""
        enough = collisions(sigs[left], sigs[right]) >= MIN_MATCH
        a, b = np.flatnonzero(enough.any(axis=1)), np.flatnonzero(enough.any(axis=0))
        if not len(a):
            return np.empty((0, 2), np.int64)
        sure = linked([sets[left[i]] for i in a], [sets[right[j]] for j in b], percent) & enough[np.ix_(a, b)]
        found = np.argwhere(sure)
        return np.stack([left[a[found[:, 0]]], right[b[found[:, 1]]]], axis=1)

    def group(rows, known):
        ids, part, out = (np.array([r[i] for r in rows]) for i in range(3))
        sets = [shingle_hashes(r[3], width, known) for r in rows]
        sigs = np.stack([signature(s, salts, factors) for s in sets])
        o = np.flatnonzero(out)
        if len(o):
            found = matches(sets, sigs, o, np.flatnonzero(~out))
            return _forest(ids, part, (p for p in found if part[p[0]] != part[p[1]]))
        every = np.arange(len(rows))
        return _forest(ids, part, (p for p in matches(sets, sigs, every, every) if p[0] < p[1]))

    def run(batches):
        known, key, rows = _WordHashes(), None, []

        def edges():
            pairs = group(rows, known) if len(rows) > 1 else []
            return bloom.batch(["a", "b"], ([a for a, _ in pairs], pa.int64()), ([b for _, b in pairs], pa.int64()))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for k1, k2, *r in zip(*cols, strict=True):
                if (k1, k2) != key:
                    if rows:
                        yield edges()
                    key, rows = (k1, k2), []
                rows.append(r)
        if rows:
            yield edges()

    return run


def near_classes(docs: DataFrame, doc_id="doc_id", text="text", width=5, percent=80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return _classified(docs, doc_id, text, width, percent).drop("hash", "first")


def _classified(docs: DataFrame, doc_id="doc_id", text="text", width=5, percent=80) -> DataFrame:
    """``near_classes`` with hash, the xxhash64 of the text, as (doc_id, hash) names a document, and
    first: whether it is the smallest of its component.

    Classes (equal shingle sets) are numbered, so that the same doc_id in two of them does no harm;
    a class is read from the text of its smallest (doc_id, hash).
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    sketches = stored(sketched(base, width), folder, "sketches")
    real = sketches.where("n > 0 AND id IS NOT NULL")
    grouped = real.groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("of"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    classes = stored(grouped.select("digest", "of.id", "of.hash", "signature", "copies", F.monotonically_increasing_id().alias("rep")), folder, "classes")
    posts = stored(postings(classes), folder, "postings")
    member = stored(memberships(posts), folder, "members")
    chunks = F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks")
    sizes = member.groupBy("centre").agg(chunks, F.count("*").alias("rows"))
    total = member.count()

    # The texts of all members: a filter of fixed size spares the others the shuffle.
    needed = stored(member.select("rep").distinct().join(classes.select("rep", "id", "hash"), "rep"), folder, "needed")
    may = bloom.membership(needed, "id")
    texts = base.where(may(F.col("id"))).join(needed, ["id", "hash"]).select("rep", "text").dropDuplicates(["rep"])
    texts = stored(texts, folder, "texts")

    def edges(rows: DataFrame, name: str) -> DataFrame:
        """rows: centre, k, rep, part, outside."""
        full = rows.join(texts, "rep").select("centre", "k", "rep", "part", "outside", "text")
        dealt = full.repartition(n, "centre", "k").sortWithinPartitions("centre", "k")
        return stored(dealt.mapInArrow(lean(_compare(width, percent)), "a long, b long"), folder, name)

    dealt = joined_by_rows(member, sizes, "centre", "rows", total).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("long"))
    inside = dealt.where("rep <> centre").union(dealt.where("rep = centre").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))))
    links = edges(inside.select("centre", "k", "rep", F.col("rep").alias("part"), F.lit(False).alias("outside")), "links")

    if not sizes.where("chunks > 1").isEmpty():
        large = sizes.where("chunks > 1").select("centre", "rows")
        labels = connected(links, folder, "inside")
        named = dealt.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("part", F.coalesce("label", "rep")).drop("label").where("chunks > 1")
        heads = named.where("rep = centre").select("centre", F.col("part").alias("head")).join(large, "centre")
        named = stored(joined_by_rows(named, heads, "centre", "rows", total).withColumn("outside", F.col("part") != F.col("head")), folder, "named")
        outs = named.where("outside").groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("outs")).join(large, "centre")
        named = joined_by_rows(named, outs, "centre", "rows", total)
        # Block (i, j): outsiders of chunk i against members of chunk j.
        j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("j")
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs").cast("long") - 1)).alias("i")
        left = named.where("outside").select("centre", "chunks", "rep", "part", F.pmod(F.xxhash64("rep"), F.col("outs")).cast("long").alias("i"), j, F.lit(True).alias("outside"))
        right = named.select("centre", "chunks", "rep", "part", i, F.col("k").alias("j"), F.lit(False).alias("outside"))
        blocks = left.union(right.select(left.columns)).select("centre", (F.col("i") * F.col("chunks") + F.col("j")).alias("k"), "rep", "part", "outside")
        links = links.union(edges(blocks, "links-across"))

    labels = connected(links, folder, "all")
    linked_classes = stored(labels.withColumnRenamed("v", "rep").join(classes.select("rep", F.struct("id", "hash").alias("of")), "rep"), folder, "labels")
    smallest = linked_classes.groupBy("label").agg(F.min("of").alias("component"), F.count("*").alias("rows"))
    components = joined_by_rows(linked_classes.select("label", "rep"), smallest, "label", "rows", linked_classes.count()).select("rep", "component")
    own = F.struct("id", "hash")
    named = classes.join(components, "rep", "left").select("digest", F.coalesce("component", own).alias("component"), "copies")
    named = stored(named, folder, "components")
    of_class = joined_by_rows(real.select("digest", "id", "hash", "n"), named, "digest", "copies", real.count()).select("id", "hash", "n", "component")
    alone = sketches.where("n = 0 OR id IS NULL").select("id", "hash", "n", own.alias("component"))
    kept = F.col("id").isNull() | (F.col("id") == F.col("component.id"))
    return of_class.union(alone).select(F.col("id").alias("doc_id"), "hash", F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"), kept.alias("kept"), (kept & (F.col("hash") == F.col("component.hash"))).alias("first"))


def near_dedup(docs: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id of their component represents."""
    names = {c: fresh(docs.columns, f"nd_{c}") for c in ("may", "id", "hash", "key")}
    gone = _classified(docs, doc_id, text, **how).where("NOT first").select(F.col("doc_id").alias(names["id"]), F.col("hash").alias(names["hash"])).distinct()
    gone = stored(gone.withColumn(names["key"], F.xxhash64(names["id"], names["hash"])), shared_folder(docs.sparkSession), "gone")
    own = [F.col(doc_id).cast("long"), F.xxhash64(F.col(text))]
    marked = docs.withColumn(names["may"], bloom.membership(gone, names["key"])(F.xxhash64(*own)))
    unsure = marked.where(names["may"]).join(gone, (own[0] == F.col(names["id"])) & (own[1] == F.col(names["hash"])), "left_anti")
    return marked.where(~F.col(names["may"])).union(unsure).drop(names["may"])


def op3(spark, sf_dir):
    return near_classes(documents(spark, sf_dir), width=4)


#: The same rows by DuckDB: all pairs that share a shingle, and a recursive closure.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON both_.a = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
