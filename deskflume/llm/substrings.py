"""Operator 4: substring de-duplication by hashing lines and the paragraphs inside them.

A document is cut into units: lines, and inside a line paragraphs that begin where the hash of two
neighbouring words is smallest among ``REACH`` words to either side. Such a border depends on the
words around it alone, so a passage that several documents share is cut alike in all of them,
wherever it stands in their lines. Units are normalised (A-Z lower-cased, white space squeezed) and
digests of those with at least ``MIN_WORDS`` words are grouped globally. Beside these parts, whole
lines and blocks of lines between blank ones are units too, with any number of words, from
``MIN_BYTES`` bytes on (four Chinese characters). The earliest occurrence, by document and then
place, stays; all others are removed. What stays keeps its original offsets.

One part of nine words can be alike by chance in two documents that share nothing else. So a part of a
line goes only where repeated units follow each other without a gap over ``RUN`` words or more; whole
lines and blocks need no such company. Of passages of 51 words inside lines 95 % are found by this,
of those of 60 words 99 %.

Cutting at line ends alone finds none of the passages that stand inside lines, hence the paragraphs.
The ends of such a passage, up to its first and from its last border, stay.

Scale: one pass finds the units, which travel as 128-bit digests with their places (no text).
Digests are grouped with partial aggregation, so a unit that a third of all documents hold is one
row from each task; the join back is an ordinary equi-join with the repeated digests only, whose
skewed side Spark splits. Runs and removed spans are grouped by document, a bounded list for each;
equal rows are merged before.

Defined results: null and empty texts have no units; a unit repeated inside its first document is
removed there as well; a unit inside another that is removed is listed among the repeated spans,
but not in ``removed``; rows without doc_id come last; rows of one doc_id, and those without, are
told apart by a hash of their text, in whose order they follow each other, so each loses its own
spans only, and equal ones count once and lose the same; other columns are kept, but for ``removed`` and ``kept``, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, shared_folder, stored

REACH = 5
MIN_WORDS = 6
#: Least size of whole lines and blocks.
MIN_BYTES = 10
#: Least number of words in a stretch of repeated units for parts of lines to go.
RUN = 16
LAST = (1 << 63) - 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of words: starts, ends."""
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words: sums of bytes times powers by place, from the end."""
    low = _LOWER[data].astype(np.uint64) + np.uint64(1)
    place = np.repeat(ends, ends - starts) - 1  # last byte of the word that a letter is in
    letters = np.flatnonzero(~_BLANK[data])
    powers = _powers(int((ends - starts).max()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low[letters] * powers[place - letters], dtype=np.uint64)])
    upto = np.cumsum(ends - starts)
    h = sums[upto] - sums[upto - (ends - starts)]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def unit_starts(hashes: np.ndarray, fresh_line: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a unit. fresh_line: which words are the first of a line."""
    n = len(hashes)
    pair = hashes * np.uint64(3) + np.concatenate([hashes[1:], hashes[:1]]) * np.uint64(0x9E3779B97F4A7C15)
    pair = (pair ^ (pair >> np.uint64(31))) >> np.uint64(1)
    line = np.cumsum(fresh_line)
    least = np.ones(n, bool)
    for d in range(1, REACH + 1):
        same = line[d:] == line[:-d]
        least[d:] &= same & (pair[d:] < pair[:-d])  # a word near its line's ends begins no unit
        least[:-d] &= same & (pair[:-d] <= pair[d:])
        least[:d] = False
        least[n - d :] = False
    return np.flatnonzero(least | fresh_line)


def units(text: str, whole: bool = True) -> list[tuple[bytes, int, int, int, int, bool]]:
    """(digest, start, end, words, at, entire) of the parts of at least MIN_WORDS words and, with
    ``whole``, of the lines and blocks of at least MIN_BYTES bytes, which are ``entire``; offsets in
    code points, ``at`` in words."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return []
    hashes = word_hashes(data, starts, ends)
    lines = np.cumsum(data == 10)[starts]
    fresh_line = np.concatenate([[True], lines[1:] != lines[:-1]])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    own = hashes.tobytes()

    def spans(first):
        return zip(first.tolist(), [*first[1:].tolist(), len(starts)], strict=True)

    parts = {(a, b) for a, b in spans(unit_starts(hashes, fresh_line)) if b - a >= MIN_WORDS}
    entire = set()
    if whole:
        fresh_block = np.concatenate([[True], lines[1:] > lines[:-1] + 1])
        size = np.concatenate([[0], np.cumsum(ends - starts + 1)])  # with the blank after each word
        entire = {(a, b) for first in (fresh_line, fresh_block) for a, b in spans(np.flatnonzero(first)) if size[b] - size[a] > MIN_BYTES}
    return [(xxhash.xxh3_128_digest(own[8 * a : 8 * b]), int(chars[starts[a]]), int(chars[ends[b - 1]]), b - a, a, (a, b) in entire) for a, b in sorted(parts | entire)]


def _units(whole: bool):
    def run(batches):
        for b in batches:
            rows = [(i, h, *u) for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if t for u in units(t, whole)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "hash", "digest", "start", "end", "words", "at", "entire"])

    return run


def repeated_spans(docs: DataFrame, doc_id="doc_id", text="text", whole: bool = False) -> DataFrame:
    """(id, start, end, words, first_id): every repeated unit but its earliest occurrence; a null id is LAST.
    ``whole``: whole lines and blocks as well. Parts of lines as far as they stand in a run of RUN words."""
    return _later(docs, doc_id, text, whole).drop("hash").distinct()


def _later(docs, doc_id, text, whole) -> DataFrame:
    """Repeated spans with the hash of the text that they stand in."""
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    found = stored(base.mapInArrow(_units(whole), "id long, hash long, digest binary, start int, end int, words int, at int, entire boolean"), shared_folder(docs.sparkSession), "units")
    place = F.struct("id", "hash", "start")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("digest", "first")
    later = found.join(groups, "digest").where(place > F.col("first"))
    return _runs(later.select("id", "hash", "start", "end", "words", "at", "entire", F.col("first.id").alias("first_id")).distinct()).drop("at", "entire")


def _runs(spans: DataFrame) -> DataFrame:
    """``spans`` without the parts of lines whose run of repeated units has fewer than RUN words."""
    text = Window.partitionBy("id", "hash")
    ordered = text.orderBy("at", "words")
    upto = F.max(F.col("at") + F.col("words")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("apart", F.coalesce(F.col("at") > upto, F.lit(True))).withColumn("run", F.sum(F.col("apart").cast("int")).over(ordered))
    run = Window.partitionBy("id", "hash", "run")
    covered = F.max(F.col("at") + F.col("words")).over(run) - F.min("at").over(run)
    return numbered.withColumn("covered", covered).where(F.col("entire") | (F.col("covered") >= RUN)).drop("apart", "run", "covered")


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``docs`` with two more columns: removed (spans with the document that keeps each, in order)
    and kept (stretches of text with their original offsets, in order)."""
    held = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "end", "words", "first_id")))
    spans = _later(docs, doc_id, text, True).groupBy("id", "hash").agg(held.alias("removed"))  # the spans of one text
    kind = "array<struct<start:int,end:int,words:int,first_id:bigint>>"
    bare = F.transform("removed", lambda x: F.struct(x["start"], x["end"], x["words"], x["first_id"]).cast(kind[6:-1]))
    outer = F.aggregate(bare, F.array().cast(kind), lambda out, x: F.when(x["end"] > F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)), F.concat(out, F.array(x))).otherwise(out))
    spans = spans.withColumn("removed", outer)
    key, mark = fresh(docs.columns, "sd_id"), fresh(docs.columns, "sd_hash")
    own = docs.drop("removed", "kept").withColumns({key: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), mark: F.xxhash64(F.col(text))})
    joined = own.join(spans.withColumnsRenamed({"id": key, "hash": mark}), [key, mark], "left").drop(key, mark)
    empty = F.array().cast(kind)
    removed = F.coalesce("removed", empty)
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["end"]))
    starts = F.concat(F.transform(removed, lambda x: x["start"]), F.array(F.char_length(F.coalesce(F.col(text), F.lit("")))))
    gaps = F.filter(F.arrays_zip(ends.alias("start"), starts.alias("end")), lambda x: x["start"] < x["end"])
    kept = F.transform(gaps, lambda x: F.struct(x["start"].alias("start"), F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"]).alias("text")))
    return joined.withColumns({"removed": removed, "kept": kept})


def op4(spark, sf_dir):
    """One row a removed span of each document."""
    spans = repeated_spans(documents(spark, sf_dir), whole=True)
    return spans.select(F.col("id").alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "words", F.col("first_id").alias("first_doc_id"))
