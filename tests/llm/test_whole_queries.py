"""Whole queries against versions that share no function with the operators, and empty tables."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from deskflume.llm import mixing, secret_scan, winnow

SF = "/root/testdata/sf0.001"


def mix(*values):
    """Spark's 64-bit hash of words or numbers, nulls left out."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<Q", v), seed=h).intdigest()
    return h


def prints(text):
    """(hash, place) of the minima of all windows of 16 grams of five words, the rightmost of equal ones."""
    one = [mix(w[k : k + 16]) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()) for k in range(0, len(w), 16)]

    def at(x, i):
        return x[i] if i < len(x) else None

    grams = []
    for i in range(max(len(one) - 4, min(len(one), 1))):
        pairs = [mix(one[k], at(one, k + 1)) if k < len(one) else None for k in (i, i + 2)]
        grams.append(mix(mix(*pairs), at(one, i + 4)) & ((1 << 36) - 1))
    out = []
    for i in range(max(len(grams) - 15, min(len(grams), 1))):
        window = grams[i : i + 16]
        low = min(window)
        place = i + max(k for k, g in enumerate(window) if g == low)
        if (low, place) not in out:
            out.append((low, place))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_query(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in winnow.op10(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        own, other, r = prints(text), prints(edited), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [",".join(f"{x:x}:{p}" for x, p in f) for f in (own, other)]
        assert abs(r.near_edited - likeness(own, other)) < 1e-12 and abs(r.near_next - likeness(own, prints(after))) < 1e-12


@pytest.fixture(scope="module")
def none(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("false")


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert secret_scan.op7(spark, str(tmp_path)).count() == 0
    assert mixing.mix_report(none).count() == 0 and mixing.mixture(none).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_with_null_sources_and_texts(spark):
    rows = [(i, None if i % 7 == 0 else "w " * (i % 9 + 1), [None, "b", "a"][i % 3]) for i in range(60)]
    got = {r.doc_id: r for r in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {i: r["size"] for i, r in got.items()} == sizes
    of = {s: sum(n for i, n in sizes.items() if rows[i][2] == s) for s in ("a", "b", None)}
    assert all(r.source_size == of[rows[i][2]] for i, r in got.items())
    # weights 5, 2, 1 in the order a, b, null; no target over twice its source
    left, targets = 1.5 * sum(of.values()), {}
    weights = {"a": 5, "b": 2, None: 1}
    while weights:
        full = [s for s, w in weights.items() if left * w / sum(weights.values()) > 2 * of[s]]
        if not full:
            targets.update({s: left * w / sum(weights.values()) for s, w in weights.items()})
            break
        for s in full:
            targets[s] = 2 * of[s]
            left -= 2 * of[s]
            del weights[s]
    taken = {s: sum(r.taken for i, r in got.items() if rows[i][2] == s) for s in of}
    assert all(abs(got[i].target - targets[rows[i][2]]) < 1e-6 for i in got)
    assert all(abs(taken[s] - targets[s]) <= 9 for s in of) and all(r.taken <= 2 * r["size"] for r in got.values())


def test_stages_keep_columns_of_other_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"row": F.lit("r"), "kept_text": F.lit("k"), "nd_key": F.lit(1), "language": F.lit("l"), "weight": F.lit(2.0)})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.select("row", "kept_text", "nd_key", "language", "weight").distinct().count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
