"""Operator 2: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Tasks split texts into words (groups of pre-tokens that no match of the pattern leaves) and gather
chunks of about ``CHUNK_TOKENS`` of them. A chunk has a dictionary of its distinct words; its
documents keep, for each position, the number of the word in it. The dictionaries are dealt out by
a hash of the word (a packed row for each chunk and part of the hash space), so every distinct word
comes to one place and is encoded there once; packed ids go back to the chunk, where documents are
put together again by position.
Decoding joins ids with the token-byte table (as many rows as the vocabulary has, so it is
broadcast); ``round_trip`` does so in the tasks that put the documents together.

Scale: a word is at most once in a chunk's dictionary, so the most frequent word has no more rows
than there are chunks and no part is hot. Tasks hold one chunk or the words of one part (cleared
beyond ``KNOWN_WORDS``, which only costs time). No temporary table is written; a lost executor
costs the chunks, of about a million words each, that its tasks had built. Chunks are named by a digest of their
content, and a chunk whose ids are missing raises an error: it would mean that ``docs`` gave other
rows when it was read the second time (store such a table first).

Defined results: null text is the empty text, which has no tokens; special tokens' strings are
ordinary text; rows of one doc_id and those without are encoded each on its own; ``encode`` ignores
other columns, ``decode`` keeps them but for one named ``decoded``, which is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CHUNK_TOKENS = 1 << 20
CUT = re.compile(r"(?<=\S)(?= )")
#: Words of documents in one row of a chunk.
BLOCK_TOKENS = 1 << 17
KNOWN_WORDS = 400_000
ROWS = "chunk long, kind int, part int, doc_ids array<long>, lengths array<int>, body binary"
PARTS, WORDS, IDS, DOCS = range(4)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed byte by byte: the high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in pairwise([4 + 4 * n, *ends])]


class Slots(dict):
    """Numbers of the words that follow a space; refuses a piece that is not cut off from its surroundings."""

    def __init__(self, words: list[str], prefix: str):
        self.words, self.prefix = words, prefix

    def __missing__(self, piece):
        if self.prefix and (not piece or piece[-1].isspace()):
            raise LookupError
        slot = self[piece] = len(self.words)
        self.words.append(self.prefix + piece)
        return slot


class _Chunk:
    """Distinct words of some documents, and the documents as the words' numbers.

    Text is cut into words at spaces that follow no white space. No match of the pattern reaches
    over such a place, so a word's pre-tokens are the same wherever it stands.
    """

    def __init__(self):
        self.words: list[str] = []
        self.spaced, self.plain = Slots(self.words, " "), Slots(self.words, "")
        self.ids, self.docs, self.tokens = [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        head, *rest = text.split(" ")
        try:
            if not head or head[-1].isspace():
                raise LookupError
            out = [self.plain[head], *map(self.spaced.__getitem__, rest)]
        except LookupError:  # other runs of white space
            out = [self.plain[x] for x in CUT.split(text)] if text else []
        self.ids.append(doc_id)
        self.docs.append(np.array(out, np.uint32))
        self.tokens += len(out)

    def rows(self, parts: int, want_docs: bool):
        """Rows of DOCS by block after one of PARTS (the part of each slot), or of WORDS by part, in order of their slots."""
        words = [x.encode() for x in self.words]
        name = xxhash.xxh3_64()
        for x in (np.array([-1 if i is None else i for i in self.ids], np.int64), np.fromiter(map(len, self.docs), np.int64, len(self.docs)), *self.docs):
            name.update(x.tobytes())
        name.update(b"\0".join(words))
        chunk = name.intdigest() - (1 << 63)
        of = [xxhash.xxh3_64_intdigest(w) % parts for w in words]
        if want_docs:
            rows, lo, held = [(chunk, PARTS, 0, None, None, pack(np.array(of, np.uint32)))], 0, 0
            for hi, d in enumerate(self.docs, 1):
                held += len(d)
                if held >= BLOCK_TOKENS or hi == len(self.docs):
                    rows.append((chunk, DOCS, lo, self.ids[lo:hi], [len(x) for x in self.docs[lo:hi]], pack(np.concatenate(self.docs[lo:hi]))))
                    lo, held = hi, 0
        else:
            by_part: dict[int, list[bytes]] = {}
            for w, p in zip(words, of, strict=True):
                by_part.setdefault(p, []).append(w)
            rows = [(chunk, WORDS, p, None, None, pack_words(own)) for p, own in by_part.items()]
        return rows


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["chunk", "kind", "part", "doc_ids", "lengths", "body"])


def chunked(docs: DataFrame, parts: int, want_docs: bool) -> DataFrame:
    """ROWS of ``docs`` (id, text): the documents, or the dictionaries, of its chunks."""

    def run(batches):
        chunk = _Chunk()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                chunk.add(ids[i].as_py(), texts[i].as_py() or "")
                if chunk.tokens >= CHUNK_TOKENS:
                    for row in chunk.rows(parts, want_docs):
                        yield _batch([row])
                    chunk = _Chunk()
        if chunk.docs:
            yield _batch(chunk.rows(parts, want_docs))

    return docs.mapInArrow(lean(run), ROWS)


def _encoder(vocabulary: dict[bytes, int], pattern: str):
    """Encodes the words of each part; rows come sorted by part."""

    def run(batches):
        bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        at = known = starts = flat = None
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != at or len(known) > KNOWN_WORDS:
                    at, known, starts, flat = row["part"], {}, array("q", [0]), array("I")
                words = unpack_words(row["body"])
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                        flat.extend(bpe.encode_ordinary(w.decode()))
                        starts.append(len(flat))
                found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                begin = np.array(starts, np.int64)
                sizes = np.diff(begin)[found]
                ids = _gather(begin[found], sizes, np.array(flat, np.uint32))
                yield _batch([(row["chunk"], IDS, row["part"], None, [len(found)], pack(np.concatenate([sizes.astype(np.uint32), ids])))])

    return run


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return flat[at + np.repeat(starts - (ends - sizes), sizes)]


def _reassemble(then):
    """Rows come sorted by (chunk, kind, part): the part of each slot, the ids of each part, the documents. then: what is done to each batch."""

    def run(batches):
        chunk = order = sizes = starts = flat = None
        ids: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["chunk"] != chunk:
                    chunk, order, sizes, ids = row["chunk"], None, None, {}
                if row["kind"] == PARTS:
                    order = unpack(row["body"])
                elif row["kind"] == IDS:
                    n, values = row["lengths"][0], unpack(row["body"])
                    ids[row["part"]] = (values[:n], values[n:])
                else:
                    if sizes is None:
                        if order is None:
                            raise ValueError("documents changed between two reads; store them first")
                        sizes = np.zeros(len(order), np.int64)
                        starts = np.zeros(len(order), np.int64)
                        pieces, base = [], 0
                        for p, slots in _by_part(order):
                            if p not in ids or len(ids[p][0]) != len(slots):
                                raise ValueError("documents changed between two reads; store them first")
                            own = ids[p][0].astype(np.int64)
                            sizes[slots], starts[slots] = own, base + np.cumsum(own) - own
                            pieces.append(ids[p][1])
                            base += int(own.sum())
                        flat = np.concatenate(pieces) if pieces else np.empty(0, np.uint32)
                    slots = unpack(row["body"])
                    tokens = _gather(starts[slots], sizes[slots], flat).astype(np.int32)
                    ends = np.cumsum(sizes[slots])
                    cuts = np.cumsum(np.array(row["lengths"], np.int64))
                    offsets = np.concatenate([[0], np.where(cuts > 0, ends[np.maximum(cuts, 1) - 1], 0)]) if len(ends) else np.zeros(len(cuts) + 1)
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))
                    yield then(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"]))

    return run


def _by_part(order: np.ndarray):
    """(part, its slots in order)."""
    at = np.argsort(order, kind="stable")
    cuts = np.flatnonzero(np.diff(order[at])) + 1
    for slots in np.split(at, cuts) if len(at) else ():
        yield int(order[slots[0]]), slots


def encode(docs: DataFrame, doc_id="doc_id", text="text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each whole text."""
    return _encoded(docs, doc_id, text, vocabulary, pattern, lambda b: b, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, doc_id="doc_id", text="text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): ``decode(encode(docs))``, decoded where the documents are put together."""
    table = _token_bytes(docs.sparkSession, vocabulary)
    return _encoded(docs, doc_id, text, vocabulary, pattern, lambda b: b.append_column("decoded", _bytes_of(b.column(1), table.value)), "doc_id long, ids array<int>, decoded binary")


def _encoded(docs, doc_id, text, vocabulary, pattern, then, schema) -> DataFrame:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * n
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(ranks(vocabulary))

    def run(batches):
        yield from _encoder(table.value, pattern)(batches)

    words = chunked(base, parts, False)
    ids = words.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(run), ROWS)
    both = ids.union(chunked(base, parts, True))
    dealt = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return dealt.mapInArrow(lean(_reassemble(then)), schema)


def _token_bytes(spark, vocabulary: str):
    """The token-byte table, broadcast."""
    return spark.sparkContext.broadcast({i: token for token, i in ranks(vocabulary).items()})


def _bytes_of(lists: pa.Array, table: dict[int, bytes]) -> pa.Array:
    look, out = table.__getitem__, []
    for own in lists:
        own = own.values
        out.append(None if own is None else b"".join(map(look, own.to_numpy(zero_copy_only=False).tolist())))
    return pa.array(out, pa.binary())


def decode(encoded: DataFrame, ids="ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with a binary column ``decoded``: each id's bytes from the token-byte table, in
    order. Null ids give null; an id outside the table raises an error."""
    table = _token_bytes(encoded.sparkSession, vocabulary)
    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded" or c == ids])
    names, at = encoded.columns, encoded.columns.index(ids)
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _bytes_of(b.column(at), table.value)], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op2(spark, sf_dir):
    return digests(round_trip(documents(spark, sf_dir)))


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
