"""Operator 8: language-model scoring by cross-entropy difference.

Words (runs of letters and digits in lower case; each other mark and each character of a script
without spaces is one of its own) and pairs of neighbouring words are counted in the target
documents and in all documents (the background). Both models share one vocabulary, the words of all
documents, whatever their number. With N words in the target, M in all, c and C their counts, and
the background's counts scaled to the target's size by s = N / M:

    b(w) = C(w) / M                      B(w | v) = (s C(v w) + STRENGTH b(w)) / (s C(v) + STRENGTH)
    t(w) = (c(w) + STRENGTH b(w)) / (N + STRENGTH)      T(w | v) = (c(v w) + STRENGTH t(w)) / (c(v) + STRENGTH)

C(v) counts v as the first of a pair. All four are distributions over the vocabulary. A document's
score is the mean over its words of the loss under T minus the loss under B, in bits: the lower,
the more it resembles the target.

Scale: tasks gather chunks of about ``CHUNK_TOKENS`` words. A chunk asks for each of its distinct
words and pairs once, as a sorted run of 64-bit hashes with their counts in the chunk, cut into
parts of the hash space. The tasks of a part add up what all chunks sent and answer each chunk with
the sums; what travels grows with the corpus, and a frequent n-gram is at most one number from each
chunk, so no part is hot. Answers meet the documents of their chunk, which carry word numbers, by
the chunk's name. There are as many parts as keep a part at some ``PART_CHARS`` characters of text,
at any input. Documents are read three times (totals, n-grams, scores). Target documents are found
by a broadcast of their ids, if these are no more than ``BROADCAST_IDS``, else by a Bloom filter of
fixed size and an exact join of the rows that pass.

Defined results: null and empty texts, and texts of white space, have no tokens and null losses and
score; without target text all scores are null; repeated rows are counted and scored each; other
columns are ignored; an empty table gives no rows; a text that changes between two reads raises an
error.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import documents, fresh

#: Weight of the next lower order, in words.
STRENGTH = 5.0
#: A word, a character of a script without spaces between words, or any other mark.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])\w)+|\S")
CHUNK_TOKENS = 1 << 20
#: Characters of text, about, whose n-grams one part holds at most.
PART_CHARS = 16_000_000
#: So many ids of target documents are broadcast (some 20 MB).
BROADCAST_IDS = 1_000_000
ROWS = "chunk long, part int, kind int, n int, target int, doc_ids binary, body binary"
REQUEST, ANSWER, WORDS, DOCS = range(4)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their lengths and sizes, byte by byte of their numbers (high bytes are mostly zero), compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * k, 8).reshape(k, 2).tolist()
    out, at = [], 8 + 16 * k
    for n, size in head:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size]).ravel())
        at += n * size
    return out


def _small(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrowest of 1, 2, 4 or 8 bytes."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = (words ^ (words >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + before
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Chunk:
    """Word numbers of some documents."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.docs, self.ids, self.target, self.tokens = [], [], [], 0

    def add(self, doc_id, target: bool, text: str | None) -> None:
        slots, out = self.slots, []
        for w in TOKEN.findall(text.lower()) if text else ():
            k = slots.get(w)
            if k is None:
                k = slots[w] = len(slots)
            out.append(k)
        self.ids.append(doc_id)
        self.target.append(target)
        self.docs.append(np.array(out, np.uint32))
        self.tokens += len(out)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.slots), np.uint64, len(self.slots))


class _Grams:
    """The n-grams of a chunk: of its words, of words as the first of a pair, and of pairs."""

    def __init__(self, hashes: np.ndarray, slots: np.ndarray, first: np.ndarray):
        """slots: the words of all documents in a row; first: which of them begin a document."""
        self.slots, self.first, n = slots.astype(np.int64), first, len(hashes)
        # A pair's number: the word before it (n before a document), then the word.
        self.before = np.where(first, n, np.concatenate([[n], self.slots[:-1]])[: len(slots)])
        self.pairs, self.pair_at = np.unique(self.before * (n + 1) + self.slots, return_inverse=True)
        v, w = np.divmod(self.pairs, n + 1)
        known = np.append(hashes, np.uint64(0))
        heads = pair_hashes(np.full(n + 1, 7, np.uint64), known)
        every = np.concatenate([hashes, heads, pair_hashes(known[v], known[w])])
        self.sorted, at = np.unique(every, return_inverse=True)
        self.word_at, self.head_at, self.pair_in = at[:n], at[n : 2 * n + 1], at[2 * n + 1 :]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Occurrences of ``sorted`` at the places ``rows`` (booleans)."""
        n = len(self.sorted)
        out = np.bincount(self.word_at[self.slots[rows]], minlength=n) + np.bincount(self.head_at[self.before[rows]], minlength=n)
        return out + np.bincount(self.pair_in[self.pair_at[rows]], minlength=n)


def _name(docs: list[np.ndarray], hashes: np.ndarray) -> int:
    h = xxhash.xxh3_64()
    for x in (np.array([len(d) for d in docs], np.int64), *docs, hashes):
        h.update(x.tobytes())
    return h.intdigest() - (1 << 63)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Sorted hashes get parts in order: the leading 32 bits, scaled."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _row(*values):
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "part", "kind", "n", "target", "doc_ids", "body"])


def _ids(ids: pa.Array | None = None, raw: bytes | None = None):
    """A column of document ids as bytes, and back."""
    if raw is not None:
        with pa.ipc.open_stream(raw) as source:
            return source.read_all().column(0).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], names=["doc_id"]))
    return sink.getvalue().to_pybytes()


def _chunked(docs: DataFrame, parts: int, want_docs: bool) -> DataFrame:
    """ROWS of the chunks of ``docs`` (doc_id, target, text): what they ask for, or their documents."""

    def rows(chunk, ids):
        hashes, slots = chunk.hashes(), np.concatenate(chunk.docs)
        name = _name(chunk.docs, hashes)
        sizes = np.array([len(d) for d in chunk.docs], np.int64)
        if want_docs:
            yield _row(name, -1, WORDS, len(hashes), 0, None, _pack(hashes))
            yield _row(name, -1, DOCS, len(sizes), 0, _ids(ids), _pack(_small(sizes), _small(slots)))
            return
        if not len(slots):
            return
        first = np.zeros(len(slots), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        grams = _Grams(hashes, slots, first)
        near = grams.counts(np.repeat(np.array(chunk.target, bool), sizes))
        every = grams.counts(np.ones(len(slots), bool))
        part = _part_of(grams.sorted, parts)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _row(name, int(part[a]), REQUEST, b - a, 0, None, _pack(np.diff(grams.sorted[a:b], prepend=np.uint64(0)), _small(near[a:b]), _small(every[a:b])))

    def run(batches):
        chunk, ids = _Chunk(), []
        for b in batches:
            at = 0
            target, texts = b.column(1), b.column(2)
            for i in range(b.num_rows):
                chunk.add(None, bool(target[i].as_py()), texts[i].as_py())
                if chunk.tokens >= CHUNK_TOKENS:
                    yield from rows(chunk, pa.concat_arrays([*ids, b.column(0).slice(at, i + 1 - at)]))
                    chunk, ids, at = _Chunk(), [], i + 1
            if at < b.num_rows:
                ids.append(b.column(0).slice(at))
        if chunk.docs:
            yield from rows(chunk, pa.concat_arrays(ids))

    return docs.mapInArrow(run, ROWS)


def _answer(batches):
    """Rows come sorted by part; each is answered with the sums of its n-grams over all rows of the part."""

    def answers(held):
        if not held:
            return
        hashes = np.concatenate([np.cumsum(h[1][0], dtype=np.uint64) for h in held])  # sent as differences
        _, at = np.unique(hashes, return_inverse=True)
        near = np.bincount(at, np.concatenate([h[1][1] for h in held]))[at].astype(np.int64)
        every = np.bincount(at, np.concatenate([h[1][2] for h in held]))[at].astype(np.int64)
        lo = 0
        for (chunk, part, n), _ in held:
            yield _row(chunk, part, ANSWER, n, 0, None, _pack(_small(near[lo : lo + n]), _small(every[lo : lo + n])))
            lo += n

    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != at:
                yield from answers(held)
                at, held = r["part"], []
            held.append(((r["chunk"], r["part"], r["n"]), _unpack(r["body"])))
    yield from answers(held)


def _losses(kind: pa.DataType, n_near: int, n_every: int):
    """Rows come sorted by (chunk, kind, part): answers, the chunk's words, its documents."""
    scale = n_near / n_every if n_every else 0.0

    def run(batches):
        chunk, near, every, hashes = None, [], [], None
        for b in batches:
            for r in b.to_pylist():
                if r["chunk"] != chunk:
                    chunk, near, every, hashes = r["chunk"], [], [], None
                if r["kind"] == ANSWER:
                    a, c = _unpack(r["body"])
                    near.append(a.astype(float))
                    every.append(c.astype(float))
                elif r["kind"] == WORDS:
                    (hashes,) = _unpack(r["body"])
                else:
                    sizes, slots = _unpack(r["body"])
                    sizes = sizes.astype(np.int64)
                    begins = np.cumsum(sizes) - sizes
                    target = background = np.zeros(0)
                    if len(slots):
                        first = np.zeros(len(slots), bool)
                        first[begins[sizes > 0]] = True
                        g = _Grams(hashes, slots, first)
                        c, big = (np.concatenate(x) if x else np.zeros(0) for x in (near, every))
                        if len(c) != len(g.sorted):
                            raise ValueError("documents changed between two reads; store them first")
                        word, head, pair = g.word_at[g.slots], g.head_at[g.before], g.pair_in[g.pair_at]
                        common = big[word] / n_every
                        own = (c[word] + STRENGTH * common) / (n_near + STRENGTH)
                        target = -np.log2((c[pair] + STRENGTH * own) / (c[head] + STRENGTH))
                        background = -np.log2((scale * big[pair] + STRENGTH * common) / (scale * big[head] + STRENGTH))
                    known = (sizes > 0) & (n_near > 0)
                    ends = begins + sizes

                    def mean(x, begins=begins, ends=ends, sizes=sizes, known=known):
                        upto = np.concatenate([[0.0], np.cumsum(x)])
                        return pa.array(np.where(known, (upto[ends] - upto[begins]) / np.maximum(sizes, 1), 0), pa.float64(), mask=~known)

                    columns = [_ids(raw=r["doc_ids"]).cast(kind), pa.array(sizes), mean(target), mean(background), mean(target - background)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _totals(batches):
    for b in batches:
        n = [len(TOKEN.findall(t.lower())) if t else 0 for t in b.column(1).to_pylist()]
        near = sum(k for k, t in zip(n, b.column(0).to_pylist(), strict=True) if t)
        chars = sum(len(t) for t in b.column(1).to_pylist() if t)
        yield pa.RecordBatch.from_arrays([pa.array([near]), pa.array([sum(n)]), pa.array([chars])], names=["near", "every", "chars"])


def word_score(docs: DataFrame, doc_id="doc_id", text="text", target="target") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of ``docs``; target: a boolean column."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(target), F.lit(False)).alias("target"), F.col(text).alias("text"))
    kind = base.schema[0].dataType
    sums = base.select("target", "text").mapInArrow(_totals, "near long, every long, chars long").agg(F.sum("near"), F.sum("every"), F.sum("chars")).first()
    near, every, chars = (int(x or 0) for x in sums)
    parts = max(2 * n, chars // PART_CHARS)
    asked = _chunked(base, parts, False).repartition(n, "part").sortWithinPartitions("part")
    both = asked.mapInArrow(_answer, ROWS).union(_chunked(base, parts, True))
    dealt = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return dealt.mapInArrow(_losses(to_arrow_type(kind), near, every), f"doc_id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")


def with_target(docs: DataFrame, ids: DataFrame, doc_id="doc_id", into="target", most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with a boolean: whether ``ids`` (one column of the name of doc_id) has the row's id.
    At most ``most`` ids are broadcast; with more, a Bloom filter spares most rows the shuffle."""
    name, key = fresh(docs.columns, "lm_may"), fresh(docs.columns, "lm_id")
    sure = ids.select(F.col(doc_id).alias(key)).distinct()

    def exact(rows, right):
        return rows.join(right, F.col(doc_id) == F.col(key), "left").withColumn(into, F.col(key).isNotNull()).drop(key)

    if sure.count() <= most:
        return exact(docs, F.broadcast(sure))
    marked = docs.withColumn(name, bloom.membership(ids, doc_id)(F.col(doc_id)))
    return marked.where(~F.col(name)).withColumn(into, F.lit(False)).unionByName(exact(marked.where(name), sure)).drop(name)


def op8(spark, sf_dir):
    """All documents against those labelled as good."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return word_score(with_target(docs, good))
