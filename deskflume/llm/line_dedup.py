"""Operator 6: line de-duplication with two Bloom filters.

One filter holds line hashes seen once, the other those seen (probably) twice. Each task lists the
filter positions of its lines; per slice of the filters, positions of all tasks are merged, and
what arrives at an occupied place goes to the second filter as well. Only lines whose hash lies in
the second filter are suspected of being repeats, and only they are shuffled, as 128-bit digests
with their document: the exact check counts documents and picks the smallest doc_id.

Scale: the filters have a fixed size (``BITS``), so what is collected and broadcast is 32 MB at any
input; a corpus with many more lines than bits only weakens the pruning - more lines are shuffled
for the exact check, the result stays the same. No group is ever gathered: a repeated line is
found from the minimum and maximum of its doc_ids, which are partially aggregated, and the very
frequent ones, fewer than there are partitions, go back to their documents by broadcast. What to
drop meets a row by its doc_id and the hash of its text, so rows without doc_id, and those that
share one, are spread.

Defined results: null or empty text is one empty line; a line's key is the line without ASCII
white space at its ends, A-Z in lower case; keys under 10 code points always stay; a line repeated
in its own first document stays there; rows of one doc_id count as one document and those without
doc_id as one that comes last; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import documents, joined_by_rows, lean, shared_folder, stored

BITS = 1 << 28
MIN_CHARS = 10
#: Hashes that a task holds before it passes their positions on.
FLUSH = 500_000
STRIP = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is under MIN_CHARS code points."""
    key = line.strip(STRIP).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return key


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _seen(batches):
    """For each slice, the positions of this task's line hashes; twice: of those in two of its documents."""

    def flush(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return bloom.by_slice(values, counts > 1, BITS)

    held, n = [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            own = {xxhash.xxh3_64_intdigest(k) for k in map(line_key, lines_of(text)) if k is not None}
            if own:
                held.append(np.fromiter(own, np.uint64, len(own)))
                n += len(own)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
    if held:
        yield flush(held)


def twice_filter(docs: DataFrame, text: str) -> bytes:
    """The filter of hashes seen twice, BITS / 8 bytes."""
    return bloom.second_filter(docs.select(text).mapInArrow(lean(_seen), bloom.ROWS), BITS)


def _suspects(shared):
    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, rows, keys = [], [], []
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = list({k for k in map(line_key, lines_of(text)) if k is not None})
                if not own:
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
                for i in np.flatnonzero(bloom.holds(bits, h, BITS)):
                    ids.append(doc)
                    rows.append(row)
                    keys.append(xxhash.xxh3_128_digest(own[i]))
            yield bloom.batch(["ld_id", "ld_hash", "ld_key"], (ids, pa.int64()), (rows, pa.int64()), (keys, pa.binary()))

    return run


def _strip(n_columns):
    def run(batches):
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(n_columns).to_pylist(), b.column(n_columns + 1).to_pylist(), strict=True):
                lines = lines_of(text)
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x in lines if (k := line_key(x)) is None or xxhash.xxh3_128_digest(k) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines).decode())
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            columns = [b.column(i) for i in range(n_columns)] + [pa.array(kept), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


def dedup_lines(docs: DataFrame, doc_id="doc_id", text="text", carry=None) -> DataFrame:
    """``docs``' columns (or those of ``carry``) in a struct ``row``, with kept_text, n_lines
    (before), n_dropped, kept_sha256."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    own = [F.coalesce(F.col(doc_id), F.lit(LAST)).alias("ld_id"), F.xxhash64(F.col(text)).alias("ld_hash"), F.col(text).alias("ld_text")]
    base = docs.select(*own)
    shared = spark.sparkContext.broadcast(twice_filter(base, "ld_text"))
    suspects = stored(base.mapInArrow(lean(_suspects(shared)), "ld_id long, ld_hash long, ld_key binary"), folder, "suspects")
    firsts = suspects.groupBy("ld_key").agg(F.min("ld_id").alias("first"), F.max("ld_id").alias("last"), F.count("*").alias("ld_rows")).where("first < last").drop("last")
    repeats = joined_by_rows(suspects, firsts, "ld_key", "ld_rows", suspects.count())
    drops = repeats.where("ld_id > first").groupBy("ld_id", "ld_hash").agg(F.collect_set("ld_key").alias("ld_drop"))  # at most the lines of one text
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), *own)
    joined = rows.join(drops, ["ld_id", "ld_hash"], "left").select("row", "ld_text", "ld_drop")
    kind = rows.select("row").schema["row"].dataType.simpleString()
    return joined.mapInArrow(lean(_strip(1)), f"row {kind}, kept_text string, n_lines long, n_dropped long, kept_sha256 string")


def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = dedup_lines(docs.select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


#: The same rows by DuckDB.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
