"""Operator 1: language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. Each language has a probability for each piece, fitted
by expectation maximisation; the probability of a word is the sum over all its segmentations into
pieces, by the forward algorithm, and a document's is the product over its words. Only letters
count; case does not.

The forward pass pushes from each place of a word to the ends of the pieces that begin there. It
follows only beginnings of pieces, so most substrings are never looked at, and keeps as many
places as the longest piece has characters, rescaled as it goes: words of any length are summed
whole.

Scale: training takes about ``SAMPLE`` documents of each language (a bound, chosen by a hash of the
id; all of them where there are fewer) and gathers distinct words with their counts; what comes
back to the driver is one number for each language and piece. Scoring is one pass over the text
without a shuffle. A task splits ``ROWS`` texts at a time and computes each distinct word once
(forgotten beyond ``KNOWN_WORDS``).

Defined results: ``und`` with score 0 for null text and text without letters (number signs such as
a half or a Roman numeral are none); with no labelled document to learn from, ``und`` for all; ties
go to the first language in code-point order; other columns are ignored, and kept by ``predict``
(one of the name of its result is replaced) and ``reject``; a row counts as held out by its id
alone (null ids are held out); repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, lean, release_memory, shared_folder, stored

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of each language in training, about.
SAMPLE = 3000
ROUNDS = 2
FOLDS = 5
#: Added to each piece's expected count; probability of a character outside the vocabulary.
PRIOR, UNKNOWN = 0.05, 1e-9
#: Texts that are split at once; words whose scores a task remembers.
ROWS = 100
KNOWN_WORDS = 100_000
#: Characters of the words that are summed side by side.
BLOCK = 200_000
#: Places between two rescalings: UNKNOWN ** RESCALE is far from underflow.
RESCALE = 16
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({x for x in every if x == x.lower() and (x == START or x.lstrip(START).isalpha())})


def stretches(text: str | None) -> list[str]:
    """Words of letters in lower case behind the start mark."""
    words = LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, words)):  # number signs that are word characters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return [START + w for w in words]


class Segmenter:
    """Sums over all segmentations of words into pieces, for all languages at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        number, begins = {}, set()
        for k, piece in enumerate(vocabulary):
            h = 0
            for c in piece:
                h = (h + ord(c) + 1) * int(self.FACTOR) & 0xFFFFFFFFFFFFFFFF
                begins.add(h)
            number[h] = k
        self.begins = np.array(sorted(begins) or [0], np.uint64)
        #: The piece that each beginning is, or n.
        self.piece = np.array([number.get(int(h), self.n) for h in self.begins], np.int64)

    def blocks(self, words: list[str]):
        """(numbers of words, code points, how many words are longer than each place), longest words first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, lo = np.argsort(-sizes, kind="stable"), 0
        while lo < len(order):
            width = int(sizes[order[lo]])
            at = order[lo : lo + max(1, BLOCK // max(width, 1))]
            lo += len(at)
            block = np.full((len(at), width), 0xFFFFFFFF, np.uint64)  # no character: no piece reaches past a word
            flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
            block[np.arange(width) < sizes[at][:, None]] = np.frombuffer(flat, np.uint32)
            yield at, block, np.searchsorted(-sizes[at], -np.arange(width + 1), "left")

    def _from(self, block: np.ndarray, i: int, n: int):
        """(end, rows, piece numbers) of the pieces that begin at place i of the first n words."""
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for j in range(i, min(i + self.longest, block.shape[1])):
            h = (h + block[rows, j] + np.uint64(1)) * self.FACTOR
            at = np.searchsorted(self.begins, h)
            at[at == len(self.begins)] = 0
            known = self.begins[at] == h
            rows, h, found = rows[known], h[known], self.piece[at[known]]
            if not len(rows):
                return
            whole = found < self.n
            if whole.any():
                yield j + 1, rows[whole], found[whole]

    def _forward(self, block, longer, table, keep=None):
        """Log probabilities of the words. keep: a list that gets (alpha, log scale, steps) of each place."""
        out = np.zeros((len(block), table.shape[1]))
        log = np.zeros_like(out)
        ahead = {0: np.ones_like(out)}
        for i in range(block.shape[1]):
            n = longer[i]  # the words that go on at this place; alpha of the others is final
            here, log = ahead.pop(i)[:n], log[:n]
            if i and i % RESCALE == 0:
                log = log + np.log(here)
                for k in ahead:
                    ahead[k] = ahead[k][:n] / here
                here = np.ones_like(here)
            steps = list(self._from(block, i, n))
            for j, rows, found in steps:
                if j not in ahead:
                    ahead[j] = np.zeros_like(here)
                ahead[j][rows] += here[rows] * table[found]
            if i + 1 not in ahead:
                ahead[i + 1] = np.zeros_like(here)
            ahead[i + 1][:n] += here * UNKNOWN
            ended = slice(longer[i + 1], n)
            out[ended] = log[ended] + np.log(ahead[i + 1][ended])
            if keep is not None:
                keep.append((here, log, steps))
        return out

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """table: a row a piece and a last one of zeros."""
        out = np.empty((len(words), table.shape[1]))
        for at, block, longer in self.blocks(words):
            out[at] = self._forward(block, longer, table)
        return out

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece: counts has a row a word, a column a language."""
        out = np.zeros((self.n + 1, table.shape[1]))
        for at, block, longer in self.blocks(words):
            keep: list = []
            total = self._forward(block, longer, table, keep)
            # What follows a place, over the word's probability, with the log scale that alpha has there.
            behind: dict = {}
            for i in range(block.shape[1] - 1, -1, -1):
                here, log, steps = keep.pop()
                n = longer[i]
                going, scale = behind.get(i + 1, (counts[:0], total[:0]))
                ended = slice(longer[i + 1], n)
                behind[i + 1] = np.concatenate([going, counts[at[ended]]]), np.concatenate([scale, total[ended]])
                beta = behind[i + 1][0] * UNKNOWN * np.exp(log - behind[i + 1][1])
                for j, rows, found in steps:
                    after, scale = behind[j]
                    flow = table[found] * after[rows] * np.exp(log[rows] - scale[rows])
                    np.add.at(out, found, flow * here[rows])
                    beta[rows] += flow
                behind[i] = (beta, log)
                behind.pop(i + self.longest, None)
        return out[:-1]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and piece probabilities (pieces + 1, languages)."""
    spark = docs.sparkSession
    vocab = pieces(vocabulary)
    labelled = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(vocab) + 1, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    point = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(point < share[F.col(lang).cast("string")]).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches):
        totals: dict[str, Counter] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals.setdefault(k, Counter()).update(stretches(t))
        for k, c in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counted = chosen.mapInArrow(lean(count), "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = counted.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))  # at most one entry a language
    words = stored(words, shared_folder(spark), "training-words")
    table = np.full((len(vocab) + 1, len(langs)), 1 / len(vocab))
    table[-1] = 0
    segmenter = spark.sparkContext.broadcast(Segmenter(vocab))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            seg, total = segmenter.value, np.zeros((len(vocab), len(langs)))
            for b in (whole.slice(k, 5000) for whole in batches for k in range(0, whole.num_rows, 5000)):
                counts = np.array([[dict(n or ()).get(k, 0) for k in langs] for n in b.column(1).to_pylist()], float).reshape(-1, len(langs))
                total += seg.expected(b.column(0).to_pylist(), counts, shared.value)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.float64()))], names=["piece", "uses"])

        uses = words.mapInArrow(lean(expect), "piece long, uses array<double>")
        sums = uses.groupBy("piece").agg(*[F.sum(F.col("uses")[k]).alias(str(k)) for k in range(len(langs))]).toPandas()
        counts = np.full((len(vocab), len(langs)), PRIOR)
        counts[sums["piece"].to_numpy(np.int64)] += sums.drop(columns="piece").to_numpy(float)
        table = np.vstack([counts / counts.sum(axis=0), np.zeros(len(langs))])
    return langs, table


def predict(docs: DataFrame, model, text="text", into="language", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with one more column, a struct of lang_pred and score (the posterior probability)."""
    langs, table = model
    segmenter = docs.sparkSession.sparkContext.broadcast(Segmenter(pieces(vocabulary)))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seg, known, scores = segmenter.value, {}, np.empty((0, len(langs)))
        for texts in batches:
            names, sure = [], []
            for lo in range(0, len(texts), ROWS):
                split = [stretches(t) for t in texts.slice(lo, ROWS).to_pylist()]
                unseen = list({w for own in split for w in own if w not in known}) if langs else []
                if len(known) + len(unseen) > KNOWN_WORDS:
                    known, unseen = {}, list({w for own in split for w in own})
                n = len(known)
                known.update(zip(unseen, range(n, n + len(unseen)), strict=True))
                if len(known) > len(scores):
                    scores = np.concatenate([scores, np.empty((len(known), len(langs)))])
                scores[n : len(known)] = seg.log_probabilities(unseen, shared.value)
                for own in split:
                    if not own or not langs:
                        names.append("und")
                        sure.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(axis=0)
                    best = int(total.argmax())
                    names.append(langs[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])
        known = scores = split = unseen = None
        release_memory()

    language = F.arrow_udf(run, "lang_pred string, score double")
    return docs.withColumn(into, language(F.col(text)))


def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    named = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def reject(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents of no recognised language; learns from the documents themselves.
    With nothing to learn from, only those of null text or text without letters go."""
    model = fit(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs.where(F.udf(lambda t: bool(stretches(t)), "boolean")(F.col("text")))
    name = fresh(docs.columns, "language")
    marked = predict(docs, model, into=name)
    return marked.where(F.col(name)["lang_pred"] != "und").drop(name)
