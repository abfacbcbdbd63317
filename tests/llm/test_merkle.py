import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from deskflume.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, hash string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(root, for each node the pairs (place, others) from below)."""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            proofs[k].append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def plain(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    sub, out = [], []
    for g in order:
        own = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, proofs = tree([h for _, h, _ in own], fanout)
        sub.append(root)
        out.append([(r, h, root, p) for (_, h, r), p in zip(own, proofs, strict=True)])
    root, uppers = tree(sub, fanout)
    for rows_, upper in zip(out, uppers, strict=True):
        for r, h, s, p in rows_:
            path = p + upper
            start = h
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                start = leaf((*r[:3], r[3] + 1, r[4]))
            for place, others in path:
                start = sha("".join(others[:place]) + start + "".join(others[place:]))
            yield r[0], h, s, root, sha("".join(x for _, others in path for x in others)), start, start == root


def rows_of(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(7, None, None, None, None), (7, "b", "en", 3, "x"), (7, "a", "en", 3, "x"), (7, "a", "en", 3, "x"), (None, "s", "en", 1, "t"), (None, "s", "é", 2, ""), (14, "s", "-", 2, "é" * 100_000), (21, "", "", None, "z"), (-7, "s", None, 0, "漢")]
    return rows


@pytest.mark.parametrize(("step", "fanout"), [(8, 2), (2, 2), (1, 3), (2, 4)])
def test_manifest_against_plain_trees(spark, monkeypatch, step, fanout):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = rows_of(spark)
    docs = spark.createDataFrame([(*r, "k", "h") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs, fanout=fanout).collect()
    want = sorted((str(w[0]), *w[1:5]) for w in plain(rows, fanout))
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, sha("".join(x for s in r.proof for x in s.others))) for r in got) == want
    checked = merkle.manifest(docs, fanout=fanout).select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert checked.where("ok").count() == len(rows)


def test_query_against_plain_trees_and_sql(spark, tmp_path):
    rows = rows_of(spark)
    spark.createDataFrame([(*r, "k", "h") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(map(str, r)) for r in merkle.op11(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(map(str, w)) for w in plain(rows))
    assert any(r[-1] == "False" for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.ORACLE})").fetchall()
    assert sorted(tuple(map(str, r)) for r in out) == got


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "t", "k", "h")], SCHEMA)
    (r,) = merkle.manifest(docs).collect()
    assert r.leaf == r.subroot == r.root == leaf((1, "s", "en", 1, "t")) and r.proof == []
    assert merkle.manifest(docs.where("false")).count() == 0
