import hashlib
import re

from pyspark.sql import functions as F

from deskflume.functions import layout
from deskflume.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain_parts(page, most):
    text = page.strip()
    if len(text) <= most:
        return [text] if text else []
    parts, held = [], ""
    for para in re.split(r"\n\s*\n", text):
        joined = f"{held}\n\n{para}" if held else para
        if len(joined) > most and held:
            parts.append(held)
            held = para
        else:
            held = joined
        while len(held) > most:
            parts.append(held[:most])
            held = held[most:]
    return parts + [held] * bool(held)


def test_page_parts(spark):
    texts = ["", " \n ", "short", "a" * 25, "a" * 10 + "\n\n" + "b" * 3, "aa\n \nbb\n\ncc\n\n" + "d" * 31 + "\n\ne", "x" * 20 + "\n\ny", "é\n\n" * 9, "p\n\n\n\nq" * 4]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, t string")
    got = {r.id: r.p for r in rows.select("id", layout.page_parts(F.col("t"), 10).alias("p")).collect()}
    assert got == {**{i: plain_parts(t, 10) for i, t in enumerate(texts)}, 99: []}


def test_table_pieces(spark):
    def table(n, wide):
        return [[f"r{i}c{k}" if i % 3 else None for k in range(wide)] for i in range(n)]

    tables = [(1, table(1, 2)), (2, table(7, 2)), (3, table(4, 9)), (4, []), (5, [[]])]
    rows = spark.createDataFrame(tables, "id long, t array<array<string>>")
    got = {r.id: r.p for r in rows.select("id", layout.table_pieces(F.col("t"), 8).alias("p")).collect()}
    line = ["| " + " | ".join(c or "" for c in r) + " |" for r in tables[1][1]]
    assert got[1] == ["|  |  |".replace("|  |  |", "|  |  |")] and got[4] == got[5] == []
    assert got[2] == ["\n".join([line[0], *line[k : k + 3]]) for k in (1, 4)] and len(got[3]) == 3


def test_heading_paths_of_whole_documents(spark):
    """Every chunk of the query against a plain walk over the lines."""
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        path, last, place = [], False, 0
        for i, line in enumerate(r.text.split("\n")):
            if not line.strip():
                continue
            heading = len(line) % 4 == 0
            if heading:
                depth = min(len(path) + 1, 3) if last else 1
                path = path[: depth - 1] + [line.strip()]
            prefix = " › ".join(path[:-1] if heading else path)
            prefix += " › " * bool(prefix)
            want[r.doc_id, place] = (i // 20 + 1, len(prefix), hashlib.sha256((prefix + line).encode()).hexdigest())
            place, last = place + 1, heading
    got = {(r.id, r.place): (r.page, r.prefix_end, r.sha) for r in QUERIES["E7_heading_paths"](spark, SF).collect()}
    assert got == want and any(n for _, n, _ in got.values())
