"""Operator 13: alignment of two tokenizers' tokens over the same bytes.

A task cuts texts into words at spaces after a visible character, which no token of either vocabulary
reaches over (checked when the vocabularies are read), and packs texts into blocks: the distinct words of a
block with their uses, and its texts as the words' numbers. Blocks are stored once in the shared folder; a
lost executor costs the blocks that its tasks had read.

Distinct words of the corpus are grouped by Spark and tokenised and aligned once each: both sides' ends are
sorted places in one array of a batch, so links are runs between searched places and groups end where both
sides do. As both sides cut at words, a text's groups are its words' groups one after another, and its counts
are sums over its words.

How often a pair of ids is linked is summed over the corpus from the distinct words' uses. The counts (at most
the product of the vocabularies, mostly far fewer) go back to the words' links by broadcast where ``SMALL``
pairs hold them all, counted first, and are summed up there, so that no word's row is shuffled for them; else the
links are shuffled by pair, and pairs with more than a partition's share are broadcast. A word keeps its places (block and number in one value), at most one a block. Its row goes there, packed
with the others of a task for the same block, and a task sums them up for each text.

A word that a side does not give back takes the tokens of all its text; then the other words of these texts
lose their uses there, which takes another join of the blocks that hold such words.

Defined results: a text that is null or empty, or that a side does not give back byte by byte (U+2581 in
it), has no tokens; special tokens' strings are ordinary text; rows of one doc_id and those without are
aligned each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CUT, Slots, pack, unpack
from .common import documents, joined_by_rows, lean, shared_folder, stored

LEFT = public_tokenizers.path("byte_bpe_50k.json")
RIGHT = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs of ids up to which their counts are broadcast.
SMALL = 1 << 20
#: Words of texts in a block; a longer text is a block of its own.
BLOCK_WORDS = 1 << 20
#: Distinct words from which on a block ends.
KNOWN_WORDS = 200_000
BLOCKS = "doc_ids array<long>, lengths array<int>, body binary, words array<string>, uses array<long>"
ALIGNED = "uses long, places array<long>, good boolean, n_a int, n_b int, n_groups int, n_links int, groups string, links array<long>"
NAMES = ["uses", "places", "good", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
#: Sums over a text's words.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "best", "n")
PACKED = "block long, last boolean, body binary, doc_ids array<long>, lengths array<int>, held int"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible bytes stand for
    themselves, the others in order for the characters from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, left: bytes, right: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        letters, model = byte_alphabet(), json.loads(left)
        added = {x["id"] for x in model["added_tokens"]}
        names = {i: t for t, i in model["model"]["vocab"].items()}
        self.left_bytes = [b"" if i in added or i not in names else bytes(letters[c] for c in names[i]) for i in range(max(names) + 1)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        made = [model["model"]["vocab"].get(x + y, -1) for x, y in merges]
        if made == sorted(made) and -1 not in made and len(set(made)) == len(made):  # merges in the order of ids: ranks give the same tokens, faster
            ranks = {t: i for i, t in enumerate(self.left_bytes) if t}
            encoding = tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_left = lambda words: list(map(encoding.encode_ordinary, words))
        else:
            tokenizer = Tokenizer.from_str(left.decode())
            tokenizer.encode_special_tokens = True
            self.encode_left = lambda words: [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
        self.right = sentencepiece.SentencePieceProcessor(model_proto=right)
        self.right_bytes = []
        for i in range(self.right.get_piece_size()):
            p = self.right.id_to_piece(i)
            self.right_bytes.append(bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace(SPACE, " ").encode())
            if SPACE in p.lstrip(SPACE):
                raise ValueError("a piece reaches over a space: words cannot be tokenised on their own")
        self.tables = (self.left_bytes, self.right_bytes)

    def encode(self, words: list[str]):
        """Token ids of both sides for words that begin with a space."""
        alone = [self.right.piece_to_id(SPACE)]  # a space at the end; the library has no token for empty text
        right = self.right.encode([w[1:] for w in words], num_threads=1)
        return self.encode_left(words), [x if len(w) > 1 else alone for w, x in zip(words, right, strict=True)]


class _Block:
    """Distinct words of some texts, and the texts as the words' numbers.

    A text cut at its spaces is its words where each is cut off from the next (``Slots`` refuses others);
    texts with other runs of white space are cut by the rule."""

    def __init__(self):
        self.words: list[str] = []
        self.spaced, self.plain = Slots(self.words, " "), Slots(self.words, "")
        self.ids, self.texts, self.held = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        """The words of a space and the text."""
        pieces = text.split(" ") if text else []
        try:
            numbers = np.fromiter(map(self.spaced.__getitem__, pieces), np.int64, len(pieces))
        except LookupError:
            own = CUT.split(" " + text)
            numbers = np.fromiter(map(self.plain.__getitem__, own), np.int64, len(own))
        self.ids.append(doc_id)
        self.texts.append(numbers)
        self.held += len(numbers)

    def row(self) -> pa.RecordBatch:
        """One row of BLOCKS. Words of both tables of slots may be equal; those of no use are of a text that was cut anew."""
        names, number = {}, np.empty(len(self.words), np.int64)
        for k, w in enumerate(self.words):
            number[k] = names.setdefault(w, len(names))
        flat = number[np.concatenate(self.texts)] if self.texts else np.empty(0, np.int64)
        uses = np.bincount(flat, minlength=len(names)).astype(np.int64)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        columns = (self.ids, list(map(len, self.texts)), pack(flat), list(names), uses)
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], names=["doc_ids", "lengths", "body", "words", "uses"])


def blocks_of(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """BLOCKS of ``docs``; a null or empty text has no words."""

    def run(batches):
        block = _Block()
        for b in batches:
            for i in range(b.num_rows):
                block.add(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if block.held >= BLOCK_WORDS or len(block.words) >= KNOWN_WORDS:
                    yield block.row()
                    block = _Block()
        if block.ids:
            yield block.row()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(run), BLOCKS)


def _side(found: list[list[int]], table: list[bytes], raw: list[bytes]):
    """Ids one after another, their number for each word, the lengths of their bytes, and whether these are the word."""
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
    good = np.array([b"".join(map(table.__getitem__, x)) == w for x, w in zip(found, raw, strict=True)], bool)
    sizes = np.fromiter(map(len, map(table.__getitem__, flat.tolist())), np.int64, len(flat))
    return flat, counts, sizes, good


def aligned_words(pair: Pair, words: list[str]):
    """Columns of ALIGNED from good on; the words' tokens of both sides stand on one line of bytes."""
    raw = [w.encode() for w in words]
    sides = [_side(x, t, raw) for x, t in zip(pair.encode(words), pair.tables, strict=True)]
    good = sides[0][3] & sides[1][3]
    flat, ends, of, counts = [], [], [], []
    for ids, n, sizes, _ in sides:
        word = np.repeat(np.arange(len(words)), n)
        kept = good[word] & (sizes > 0)
        flat.append(ids[kept])
        ends.append(np.cumsum(sizes[kept]))
        of.append(word[kept])
        counts.append(np.bincount(of[-1], minlength=len(words)))
    (a, b), (ea, eb) = flat, ends
    first = np.searchsorted(eb, np.concatenate([[0], ea[:-1]]), "right") if len(ea) else np.empty(0, np.int64)
    run = np.searchsorted(eb, ea, "left") - first + 1  # tokens of the right side that each of the left meets
    at = np.repeat(first - (np.cumsum(run) - run), run) + np.arange(run.sum())
    links = (np.repeat(a, run) << 32) + b[at]
    n_links = np.bincount(np.repeat(of[0], run), minlength=len(words))
    group = [np.searchsorted(both, e, "left") for both in [np.intersect1d(ea, eb, assume_unique=True)] for e in ends]  # of each token
    closes = np.concatenate([group[0][1:] != group[0][:-1], [True]]) if len(a) else np.empty(0, bool)
    n_groups = np.bincount(of[0][closes], minlength=len(words))
    pieces, keys = [], []
    for s in range(2):
        g = group[s]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        begins = np.concatenate([[True], of[s][1:] != of[s][:-1]]) if len(g) else new
        before = np.where(new, "|" if s else np.where(begins, "", ";"), ",").tolist()
        pieces += [x + str(i) for x, i in zip(before, flat[s].tolist(), strict=True)]
        keys.append(2 * g + s)
    order = np.argsort(np.concatenate(keys), kind="stable").tolist()
    pieces = [pieces[k] for k in order]
    upto = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
    groups = ["".join(pieces[lo:hi]) for lo, hi in zip(upto, upto[1:])]
    offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
    return [pa.array(good), *(pa.array(x.astype(np.int32)) for x in (*counts, n_groups, n_links)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(links))]


def aligned(words: DataFrame, left=LEFT, right=RIGHT) -> DataFrame:
    """ALIGNED of distinct words (word, uses, places)."""
    models = []
    for path in (left, right):
        with open(path, "rb") as f:
            models.append(f.read())
    shared = words.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        pair = None
        for b in batches:
            if b.num_rows:
                pair = pair or Pair(*shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *aligned_words(pair, b.column(0).to_pylist())], names=NAMES)

    return words.select("word", "uses", "places").mapInArrow(lean(run), ALIGNED)


def _texts(numbers: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Which text each of the words is of."""
    return np.repeat(np.arange(len(lengths)), lengths)


def _lost(batches):
    """(block, slot, less): the uses of words in texts with a bad word; bad: the numbers of these in the block."""
    for b in batches:
        for row in b.to_pylist():
            numbers, lengths, words = unpack(row["body"]).astype(np.int64), row["lengths"], row["words"]
            marked = np.zeros(words, bool)
            marked[row["bad"]] = True
            text = _texts(numbers, lengths)
            dropped = np.zeros(len(lengths), bool)
            dropped[text[marked[numbers]]] = True
            less = np.bincount(numbers[dropped[text]], minlength=words)
            held = np.flatnonzero(less)
            block = np.full(len(held), row["block"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(held.astype(np.int32)), pa.array(less[held].astype(np.int64))], names=["block", "slot", "less"])


def _added(batches):
    """(places, SUMS, groups), one row a word, of rows (w, begins, places, SUMS, groups), one a link: a word's
    links come one after another, the first with what is the word's own; best and n are summed up over them."""

    def row(own, *sums):
        columns = [*own.columns[2:-3], *(pa.array(x, pa.int64()) for x in sums), own.columns[-1]]
        return pa.RecordBatch.from_arrays(columns, names=["places", *SUMS, "groups"])

    last, held = None, np.zeros(2, np.int64)  # the word begun last, and the sums of its links up to here
    for b in batches:
        w, begins = b.column(0).to_numpy(), np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False))
        ends = np.concatenate([begins, [b.num_rows]])
        before = np.full(ends[0], last.column(0)[0].as_py() if last else -1)
        if not np.array_equal(w, np.concatenate([before, np.repeat(w[begins], np.diff(ends))])):
            raise ValueError("a word's links do not follow each other")
        sums = np.stack([np.concatenate([[0], np.cumsum(b.column(c).to_numpy())]) for c in (-3, -2)])
        held = held + sums[:, ends[0]]
        if len(begins):
            if last:
                yield row(last, *held[:, None])
            own, totals = b.take(pa.array(begins)), sums[:, ends[1:]] - sums[:, ends[:-1]]
            yield row(own.slice(0, len(begins) - 1), *totals[:, :-1])
            last, held = own.slice(len(begins) - 1), totals[:, -1]
    if last:
        yield row(last, *held[:, None])


def _packed(batches):
    """PACKED of rows (block, slot, SUMS, groups) that come sorted by block: one for each block, its columns compressed."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")

    def row(block, held):
        sink = pa.BufferOutputStream()
        whole = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema, options=option) as out:
            out.write_table(whole)
        columns = zip([block, False, sink.getvalue().to_pybytes(), None, None, None], (pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], names=["block", "last", "body", "doc_ids", "lengths", "held"])

    at, held = None, []
    for b in batches:
        blocks = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and blocks[lo] != at:
                    yield row(at, held)
                    held = []
                at = int(blocks[lo])
                held.append(pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns[1:]], names=["slot", *SUMS, "groups"]))
    if held:
        yield row(at, held)


def _summed(batches):
    """RESULT of PACKED rows that come sorted by (block, last): the words of a block, then its texts."""
    held = []
    for b in batches:
        for k in range(b.num_rows):
            if not b.column("last")[k].as_py():
                held.append(pa.ipc.open_stream(b.column("body")[k].as_buffer()).read_all())
                continue
            row = b.slice(k, 1).to_pylist()[0]
            if sum(t.num_rows for t in held) != row["held"]:
                raise ValueError("a block's words are not all there")
            facts = pa.concat_tables(held).sort_by("slot") if held else None
            values = np.stack([facts.column(c).to_numpy() for c in SUMS]) if held else np.empty((len(SUMS), 0), np.int64)
            yield _rows(row, values, facts.column("groups").to_pylist() if held else [])
            held = []


def _rows(row: dict, values: np.ndarray, groups: list) -> pa.RecordBatch:
    numbers, lengths = unpack(row["body"]).astype(np.int64), row["lengths"]
    upto = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    good = values[0] >= 0  # a bad word has -1
    bad = np.concatenate([[0], np.cumsum(~good[numbers])])
    kept = bad[upto[1:]] == bad[upto[:-1]]
    sums = []
    for v in values:
        total = np.concatenate([[0], np.cumsum(v[numbers])])
        sums.append(np.where(kept, total[upto[1:]] - total[upto[:-1]], 0))
    shas, show = [], groups.__getitem__
    for lo, hi, good in zip(upto.tolist(), upto[1:].tolist(), kept.tolist()):
        shas.append(hashlib.sha256(";".join(map(show, numbers[lo:hi].tolist())).encode()).hexdigest() if good and hi > lo else "")
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, sums), pa.array(shas, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])


def placed(words: DataFrame, *columns) -> DataFrame:
    """(block, slot) of each place of ``words``, and columns."""
    spread = words.select(F.explode("places").alias("place"), *columns)
    return spread.select(F.shiftright("place", 32).alias("block"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("slot"), *columns)


def alignment(docs: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """One row a text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    folder, parts = shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(blocks_of(docs, doc_id, text).withColumn("block", F.monotonically_increasing_id()), folder, "blocks", "zstd")
    numbers = blocks.select("block").withColumn("number", F.row_number().over(Window.orderBy("block")).cast("long"))  # ids of blocks, of a million words each
    blocks = blocks.join(F.broadcast(numbers), "block").drop("block").withColumnRenamed("number", "block")
    own = F.transform(F.arrays_zip("words", "uses"), lambda x, i: F.struct(x["words"].alias("word"), x["uses"].alias("uses"), (F.shiftleft("block", 32) + i).alias("place")))
    used = blocks.select(F.inline(own)).groupBy("word").agg(F.sum("uses").alias("uses"), F.collect_list("place").alias("places"))  # at most one a block
    words = stored(aligned(used, **how).withColumn("w", F.monotonically_increasing_id()), folder, "words", "zstd")
    every, bad = words, words.where("NOT good")
    if not bad.isEmpty():
        hit = placed(bad).groupBy("block").agg(F.collect_list("slot").alias("bad"))
        lost = blocks.join(hit, "block").select("block", "lengths", "body", F.size("words").alias("words"), "bad").mapInArrow(lean(_lost), "block long, slot int, less long")
        less = placed(words, "w").join(lost, ["block", "slot"]).groupBy("w").agg(F.sum("less").alias("less"))
        words = words.join(less, "w", "left").withColumn("uses", F.col("uses") - F.coalesce("less", F.lit(0))).drop("less")
    each = words.where("good AND uses > 0").select("w", "uses", F.explode("links").alias("pair"))
    counts = stored(each.groupBy("pair").agg(F.sum("uses").alias("n"), F.count("*").alias("rows")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), folder, "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = stored(counts.join(most, "b").select("pair", "n", "rows", (F.col("n") == F.col("most")).cast("long").alias("best")), folder, "pairs")
    nil = F.lit(0).cast("long")
    own = [F.when(F.col("good"), F.col(c)).otherwise(-1 if c == "n_a" else 0).cast("long").alias(c) for c in SUMS[:4]]
    sums = [F.coalesce(c, nil).alias(c) for c in SUMS[4:]]
    facts = every.select("w", "places", *own, "groups", "links")
    if known.count() <= SMALL:
        links = facts.select(*facts.columns[:-1], F.posexplode_outer("links").alias("at", "pair")).withColumn("begins", F.coalesce("at", F.lit(0)) == 0)
        met = links.join(F.broadcast(known.drop("rows")), "pair", "left")
        kept = [F.when(F.col("begins"), F.col(c)).alias(c) for c in ("places", *SUMS[:4], "groups")]
        facts = met.select("w", "begins", *kept[:-1], *sums, kept[-1]).mapInArrow(lean(_added), f"places array<long>, {', '.join(f'{c} long' for c in SUMS)}, groups string")
    else:
        met = joined_by_rows(each.select("w", "pair"), known, "pair", "rows", known.agg(F.sum("rows")).first()[0])
        facts = facts.join(met.groupBy("w").agg(F.sum("best").alias("best"), F.sum("n").alias("n")), "w", "left").select("places", *SUMS[:4], *sums, "groups")
    of_words = placed(facts, *SUMS, "groups").sortWithinPartitions("block").mapInArrow(lean(_packed), PACKED)
    of_texts = blocks.select("block", F.lit(True).alias("last"), "body", "doc_ids", "lengths", F.size("words").alias("held"))
    dealt = of_words.unionByName(of_texts).repartition(parts, "block").sortWithinPartitions("block", "last")
    return dealt.mapInArrow(lean(_summed), RESULT)


def op13(spark, sf_dir):
    return alignment(documents(spark, sf_dir))
