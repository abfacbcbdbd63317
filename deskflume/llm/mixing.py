"""Operator 9: mix sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words its source has served up to and
including it, divided by the source's target. Because the targets add up to the total budget, all
sources use up their share at virtual time 1, so the globally range-sorted schedule is truncated
there; the document in service at that moment contributes the words already served.

Scale: the text is read once for its size. Cumulative words inside a source are two-level (sums
per bucket of the shuffle order, then inside a bucket), so a source that holds a third of all rows
is spread over as many buckets as its row count asks for and never meets in one task. Rows without
doc_id take their place in the shuffle by a hash of their text, so they are spread as well. The
mixed corpus schedules narrow rows (ids, sizes, a 128-bit hash of the row); whole rows then meet
their places by that hash in one shuffle, equal rows as one, and are range-sorted in another.

Defined results: null or blank text has size 0 and is never taken; a null source is a source of its
own, ranked last; a source without words has target 0; repeated rows queue one after another; an
empty table gives no rows; other columns are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, shared_folder, stored

#: Rows of one source in one bucket of the shuffle order, about.
BUCKET_ROWS = 8000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget=1.5, max_repeats=2) -> DataFrame:
    """(mx_none, mx_src, source_size, source_rows, all_rows, target) of each source: weighted shares of
    ``budget`` times all words, no target above ``max_repeats`` times its source, excess reshared.

    The reshare has a closed form: sources sorted by cap over weight fill up in that order, and
    one is full if the level that the rest would reach lies at or above it.
    """
    per = sizes.groupBy("mx_none", "mx_src").agg(F.sum("mx_size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = Window.partitionBy(F.lit(1))  # one row a source
    rank = F.row_number().over(everything.orderBy("mx_none", "mx_src")) - 1
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", choice).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_fill = everything.orderBy(F.col("cap") / F.col("w"), "mx_none", "mx_src")
    before, since = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.sum("w").over(since) <= F.col("left") * F.col("w"))
        .withColumn("spare", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("spare") / F.col("open_w"))
    return per.select("mx_none", "mx_src", "source_size", "source_rows", F.sum("source_rows").over(everything).alias("all_rows"), target.alias("target"))


def schedule(docs: DataFrame, doc_id="doc_id", source="source", size="size", tie="tie", seed="mix", **shares) -> DataFrame:
    """``docs`` (with columns of sizes and of hashes that order rows without doc_id) plus source_size,
    target, taken, copies, virtual_finish.

    ``docs`` is read twice: once for sums, once for the schedule. taken: words the mix takes, over
    all passes; copies: passes that take at least half of the document; virtual_finish: of its
    first pass, null if its source has no target.
    """
    keyed = docs.withColumns({
        "mx_none": F.col(source).isNull().cast("int"),
        "mx_src": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "mx_size": F.coalesce(F.col(size), F.lit(0)).cast("long"),
        "mx_key": F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("none "), F.col(tie).cast("string")))).cast("binary")),
    })
    keys, passes = ["mx_none", "mx_src"], int(shares.get("max_repeats", 2))
    targets = source_targets(keyed, **shares)
    # An order-preserving bucket of the shuffle key: its leading 32 bits, scaled to the source's number of buckets.
    lead = F.conv(F.substring("mx_key", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("source_rows") / F.lit(BUCKET_ROWS)).cast("long")
    # Sources with more than a partition's share of all rows, at most as many as there are partitions,
    # are broadcast, so their rows stay where they are; the others meet their targets in a shuffle.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, cold = (targets.where(F.expr(f"{sign} (source_rows * {n} > all_rows)")).drop("all_rows") for sign in ("", "NOT"))
    apart = keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    placed = keyed.join(F.broadcast(hot), keys).unionByName(apart).withColumn("mx_bucket", F.shiftright(lead * buckets, 32))
    by_bucket = Window.partitionBy(*keys).orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "mx_bucket").agg(F.sum("mx_size").alias("mx_sum")).select(*keys, "mx_bucket", F.coalesce(F.sum("mx_sum").over(by_bucket), F.lit(0)).alias("mx_offset"))
    queue = Window.partitionBy(*keys, "mx_bucket").orderBy("mx_key", doc_id, "mx_size", tie).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("mx_offset") + F.sum("mx_size").over(queue)
    timed = placed.join(offsets, [*keys, "mx_bucket"]).withColumn("mx_end", end)
    cut = F.floor(F.col("target") + 0.5)  # virtual time 1, in words of the source
    served = [F.greatest(F.lit(0), F.least(F.col("mx_size"), cut - (F.lit(e) * F.col("source_size") + F.col("mx_end") - F.col("mx_size")))) for e in range(passes)]
    return timed.withColumns({
        "taken": sum(served[1:], served[0]).cast("long"),
        "copies": sum([((s > 0) & (2 * s >= F.col("mx_size"))).cast("int") for s in served[1:]], ((served[0] > 0) & (2 * served[0] >= F.col("mx_size"))).cast("int")),
        "virtual_finish": F.when(F.col("target") > 0, F.col("mx_end") / F.col("target")),
    }).drop("mx_none", "mx_src", "mx_key", "mx_bucket", "mx_offset", "mx_end", "mx_size", "source_rows")


def sized(docs: DataFrame, folder: str, doc_id="doc_id", source="source", text="text") -> DataFrame:
    """(doc_id, source, size, tie) of all documents, stored: the only pass over the text."""
    tie = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text)))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), tie.alias("tie"))
    return stored(narrow, folder, "sizes")


def _hashable(docs: DataFrame) -> list[Column]:
    """What tells rows of ``docs`` apart by hash: which columns are null, and the columns, nested ones as JSON."""
    columns = [F.col(f"`{x.name}`") for x in docs.schema]
    nested = ["<" in x.dataType.simpleString() for x in docs.schema]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [nulls, *(F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if deep else c for c, deep in zip(columns, nested, strict=True))]


def mixture(docs: DataFrame, doc_id="doc_id", source="source", text="text", **shares) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with ``docs``' columns, each as often as the mix takes at
    least half of it, in the order of virtual finish times. ``docs`` is read twice."""
    own = _hashable(docs)
    keys = [F.xxhash64(*own).alias("mx_k"), F.xxhash64(F.lit(1), *own).alias("mx_l")]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *keys)
    narrow = stored(narrow.withColumn("tie", F.col("mx_k")), shared_folder(docs.sparkSession), "sized")
    repeated = schedule(narrow, **shares).where("copies > 0").withColumn("mx_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = F.col("virtual_finish") + F.col("mx_pass") * F.col("source_size") / F.col("target")
    places = repeated.select("mx_k", "mx_l", finish.alias("mx_finish"), "doc_id")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mx_row"), *keys)
    whole = whole.groupBy("mx_k", "mx_l").agg(F.first("mx_row").alias("mx_row"))  # equal rows are one
    return whole.join(places, ["mx_k", "mx_l"]).orderBy("mx_finish", "doc_id", "mx_k").select("mx_row.*")


def mix_report(docs: DataFrame, **shares) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, virtual_finish, in schedule order."""
    spark = docs.sparkSession
    timed = schedule(sized(docs, shared_folder(spark)), **shares)
    return timed.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish").orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")


#: The same rows by DuckDB, from the documents themselves.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, (source IS NULL)::INT AS none_,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || doc_id::VARCHAR) AS k
  FROM documents),
s AS (SELECT none_, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY none_, src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, none_, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
             sum(w) OVER (ORDER BY cap / w, none_, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS since FROM w),
g AS (SELECT *, cap * since <= left_ * w AS full_ FROM f),
t AS (SELECT none_, src, source_size, CASE WHEN full_ THEN cap ELSE w * (total - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / sum(w) FILTER (NOT full_) OVER () END AS target FROM g),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5) AS cut,
             sum(d.size) OVER (PARTITION BY d.none_, d.src ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS ends
      FROM d JOIN t USING (none_, src))
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, cut - (ends - size))) + greatest(0, least(size, cut - (source_size + ends - size))))::BIGINT AS taken,
       CASE WHEN target > 0 THEN ends / target END AS virtual_finish
FROM q
"""
