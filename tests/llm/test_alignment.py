import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from deskflume.llm import alignment

ODD = [None, "", " ", "\n", "a", " lead", "tail ", "a  b   c", "tab\tand\r\n\n new", "é　漢字 😀 x", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 5000, "word " * 3000, "it's 12345 \x1c \x85 \xa0z", "ﬁ Ǻ a\x00b", "end.\n"]


def plain(texts):
    """The contract's rows by whole texts and plain loops over all pairs of ranges."""
    left = Tokenizer.from_file(alignment.LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=alignment.RIGHT)
    letters = alignment.byte_alphabet()
    found = []
    for text in texts:
        a = b = ()
        if text:
            ids = left.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(letters[c] for c in left.id_to_token(i))) for i in ids]
            b = [(i, bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, right.id_to_piece(i)) for i in right.encode(text))]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = ()
        groups, links, i, j, at, bt = [], [], 0, 0, 0, 0
        left_group, right_group = [], []
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            ae, be = at + len(a[i][1]), bt + len(b[j][1])
            if ae <= be:
                left_group.append(a[i][0])
                at, i = ae, i + 1
            if be <= ae:
                right_group.append(b[j][0])
                bt, j = be, j + 1
            if ae == be:
                groups.append(",".join(map(str, left_group)) + "|" + ",".join(map(str, right_group)))
                left_group, right_group = [], []
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for *_, links in found for x in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for n_a, n_b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha


@pytest.mark.parametrize(("small", "known"), [(alignment.SMALL, alignment.KNOWN_WORDS), (-1, 100)])
def test_alignment_against_plain_loops(spark, monkeypatch, small, known):
    monkeypatch.setattr(alignment, "SMALL", small)
    monkeypatch.setattr(alignment, "KNOWN_WORDS", known)
    monkeypatch.setattr(alignment, "BLOCK_WORDS", 1000 if small > 0 else 1 << 19)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1, t) for t in ODD] + [(None, "of no id"), (None, "of no id"), (1, "of no id")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, row string, links string, pair string").repartition(4)
    got = sorted(map(str, (tuple(r) for r in alignment.alignment(docs).collect())))
    assert got == sorted(str((i, *x)) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True))
    assert sum("''" in x for x in got) == 4
    assert alignment.alignment(docs.where("false")).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r) for r in alignment.op13(spark, sf).collect()}
    assert got == {(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]), strict=True)}


def test_links_are_summed_where_their_words_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} and more of them") for i in range(20)], "doc_id long, text string")
    plan = alignment.alignment(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w#" not in plan and "hashpartitioning(block#" in plan
    monkeypatch.setattr(alignment, "SMALL", -1)
    assert "hashpartitioning(w#" in alignment.alignment(docs)._jdf.queryExecution().executedPlan().toString()


def test_added_over_batches_of_any_size():
    links = [3, 1, 5, 1, 1, 4]  # of each word
    names = ["w", "begins", "places", *alignment.SUMS, "groups"]
    kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.int64()] * 6, pa.string()]
    rows = [(k, i == 0, *(([k, k + 9], 1, 2, 3, k) if i == 0 else [None] * 5), i % 2, 10 * k + i, str(k) if i == 0 else None) for k, n in enumerate(links) for i in range(n)]
    want = [([k, k + 9], 1, 2, 3, k, n // 2, sum(10 * k + i for i in range(n)), str(k)) for k, n in enumerate(links)]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    for size in range(1, len(rows) + 1):
        got = [tuple(r.values()) for b in alignment._added(batch(rows[k : k + size]) for k in range(0, len(rows), size)) for r in b.to_pylist()]
        assert got == want
    assert list(alignment._added([])) == list(alignment._added([batch([])])) == []
    with pytest.raises(ValueError, match="links"):
        list(alignment._added([batch(rows[:3] + rows[5:6])]))
