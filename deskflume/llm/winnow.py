"""Operator 10: document fingerprints by winnowing, with SQL functions only.

A text is a sequence of tokens (words in lower case; very long ones in pieces). Hashes of ``GRAM``
neighbouring tokens are put together by doubling (1, 2, 4 tokens, and one more), so every hash is
reused by its neighbours. In each window of ``WINDOW`` hashes the smallest is selected, the
rightmost one of equal ones, and kept with its position. Two texts that share
GRAM + WINDOW - 1 = 20 tokens in a row share a selected hash.

A selected value is one number: 36 bits of hash, then 27 bits that fall with the position, so the
smallest number is the smallest hash furthest to the right. Window minima are found by doubling as
well, in log2(WINDOW) passes over the array.

Scale: the neighbour of a document in the order of ids comes from a range-partitioned narrow table
(ids and lengths), never from one global sort of texts. Texts are shuffled once by id; what a
document sends to its predecessor is the head that the predecessor needs, and its fingerprint.

Defined results: null text is the empty text, with an empty fingerprint; two empty fingerprints are
alike (1), an empty and another one are not (0); fewer tokens than GRAM are one gram, fewer grams
than WINDOW one window; rows of one doc_id are fingerprinted each and share the next document,
which is a row of the next greater id (of several, one chosen by the hash of its text); rows without
doc_id have the empty text as the next; with a single id, a document is its own next; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, documents, shared_folder, stored

GRAM = 5
WINDOW = 16
TOKEN = rf"[^{BLANKS}]{{1,16}}"
HASH_BITS, PLACE_BITS = 36, 27


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def let(value: Column, then) -> Column:
    """then(value), with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _paired(values: Column, by: int, step) -> Column:
    return let(values, lambda v: F.zip_with(v, _shifted(v, by), step))


def gram_hashes(tokens: Column) -> Column:
    """Hashes of GRAM tokens in a row; of all tokens if they are fewer."""

    def both(a, b):
        return F.xxhash64(a, b)

    def five(one):
        four = _paired(_paired(one, 1, both), 2, both)
        return F.slice(F.zip_with(four, _shifted(one, 4), both), 1, F.greatest(F.size(one) - GRAM + 1, F.least(F.size(one), F.lit(1))))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), five)


def selected(hashes: Column) -> Column:
    """Packed hash and position of the minimum of each window, in order, each once."""
    cut, last = (1 << HASH_BITS) - 1, (1 << PLACE_BITS) - 1

    def least(a, b):  # passes over the nulls past the end
        return F.least(a, b)

    def minima(values):
        n = F.size(values)
        for by in (1, 2, 4, 8):  # windows of 2, 4, 8, 16
            values = _paired(values, by, least)
        return F.array_distinct(F.slice(values, 1, F.greatest(n - WINDOW + 1, F.least(n, F.lit(1)))))

    packed = F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(cut)), PLACE_BITS).bitwiseOR(F.lit(last) - i.cast("long")))
    return let(packed, minima)


def fingerprint(text: Column) -> Column:
    return selected(gram_hashes(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))))


def shown(values: Column) -> Column:
    """hash:position, comma-joined."""
    last = (1 << PLACE_BITS) - 1
    return F.array_join(F.transform(values, lambda v: F.concat_ws(":", F.lower(F.hex(F.shiftright(v, PLACE_BITS))), F.lit(last) - v.bitwiseAND(F.lit(last)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes over all distinct hashes."""

    def hashes(values):
        return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, PLACE_BITS)))

    def share(z):
        every = z["x"] + z["y"] - z["both"]
        return F.when(every == 0, 1.0).otherwise(z["both"] / every)

    sizes = let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), lambda z: F.struct(F.size(z["x"]).alias("x"), F.size(z["y"]).alias("y"), F.size(F.array_intersect(z["x"], z["y"])).alias("both")))
    return let(sizes, share)


def predecessors(rows: DataFrame) -> DataFrame:
    """(key, prev_key, prev_n) of ``rows`` (doc_id, key, n_chars): what precedes each id; the last id precedes the first."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.max("n_chars").alias("n_chars"))
    ids = stored(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), shared_folder(spark), "ids")
    me = F.struct("doc_id", "key", "n_chars")
    in_order = Window.partitionBy("part").orderBy("doc_id")
    over_parts = Window.partitionBy(F.lit(1)).orderBy("part")  # one row a partition
    before = ids.groupBy("part").agg(F.max(me).alias("end")).select("part", F.lag("end").over(over_parts).alias("end"), F.max("end").over(Window.partitionBy(F.lit(1))).alias("very_last"))
    prev = ids.withColumn("prev", F.lag(me).over(in_order)).join(F.broadcast(before), "part").withColumn("prev", F.coalesce("prev", "end", "very_last"))
    return prev.select("key", F.col("prev.key").alias("prev_key"), F.col("prev.n_chars").alias("prev_n"))


def half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def with_neighbours(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, text, edited, fp, edited_fp, next_fp): each text, its edited text and fingerprints."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    # A key that is never null; rows without doc_id are spread by their text.
    key = F.coalesce(F.concat(F.lit("d"), F.col(doc_id).cast("string")), F.concat(F.lit("t"), F.xxhash64(body).cast("string")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), body.alias("text"))
    prevs = predecessors(rows.select("doc_id", "key", F.char_length("text").alias("n_chars")))
    base = rows.withColumn("fp", fingerprint(F.col("text"))).repartition(n, "key")
    # doc_id stays in this branch so that both read one and the same exchange.
    once = Window.partitionBy("key").orderBy(F.xxhash64("text"), "doc_id")
    sent = base.withColumn("rank", F.row_number().over(once)).where("rank = 1").join(prevs.withColumnRenamed("key", "own"), F.col("key") == F.col("own"))
    sent = sent.select(F.col("prev_key").alias("key"), F.substring("text", F.lit(1), half(F.col("prev_n"))).alias("head"), F.col("fp").alias("next_fp"))
    size = F.char_length("text")
    head = F.substring(F.coalesce("head", F.lit("")), F.lit(1), half(size))
    edited = F.concat(F.substring("text", F.lit(1), size - half(size)), head)
    joined = base.join(sent, "key", "left").withColumn("edited", edited)
    return joined.select("doc_id", "text", "edited", "fp", fingerprint(F.col("edited")).alias("edited_fp"), F.coalesce("next_fp", F.array().cast("array<bigint>")).alias("next_fp"))


def op10(spark, sf_dir):
    rows = with_neighbours(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
