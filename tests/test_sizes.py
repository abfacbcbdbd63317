"""Cases that showed on larger tables only."""

import os
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskflume.functions import facts, layout, text, values
from deskflume.plans import ORACLES, QUERIES
from deskflume.plans.knowledge import rendered_parts
from deskflume.plans.more import CLASSIFIED

SF = "/root/testdata/sf0.001"


@pytest.fixture
def halfway(tmp_path):
    """The tables, with 800 customers whose names have 1.03625 characters on average."""
    for name in CLASSIFIED:
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    (tmp_path / "customer.parquet").unlink()
    n = range(800)
    rows = pd.DataFrame({"c_custkey": n, "c_name": ["aa" if i < 29 else "a" for i in n], "c_nationkey": 1, "c_acctbal": 1.5, "c_mktsegment": "x"}).astype({"c_nationkey": "int32"})
    rows.to_parquet(tmp_path / "customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["F1_column_cards", "A20_column_shapes"])
def test_means_between_two_roundings(spark, halfway, query):
    con = duckdb.connect()
    for name in CLASSIFIED:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{halfway}/{name}.parquet'")
    want = con.execute(f"SELECT name, mean_length FROM ({ORACLES[query]}) ORDER BY name").fetchall()
    got = sorted((r.name, r.mean_length) for r in QUERIES[query](spark, halfway).collect())
    assert got == want and dict(got)["c_name" if query[0] == "A" else "customer_c_name"] == 1.0362


@pytest.mark.parametrize("query", ["F1_column_cards", "F5_bounds", "F5_exemplars"])
def test_times_of_whole_seconds(spark, tmp_path, query):
    """Of 6,000,000 events some have no fraction; at sf0.1 none has."""
    con = duckdb.connect()
    for name in CLASSIFIED:
        file = f"{SF}/{name}.parquet"
        if name == "events":
            con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_microseconds(CASE event_id % 9 WHEN 0 THEN 10000000 WHEN 1 THEN 600000000 ELSE 5000000 + event_id * 10 END) AS ts) FROM '{file}') TO '{tmp_path}/{name}.parquet'")
        else:
            os.symlink(file, tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    rows = QUERIES[query](spark, str(tmp_path))
    columns = ", ".join(rows.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[query]}) WHERE name = 'events_ts' ORDER BY ALL").fetchall()
    assert want and sorted(map(tuple, rows.where("name = 'events_ts'").collect())) == want


def test_facts_compute_their_functions_once(spark):
    plan = facts.facts(spark.createDataFrame([(1, "in 5 days")], "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[scan(") == 1 and plan.count("[_standing(") == 1


def test_parts_are_dealt_out_before_they_are_read(spark):
    assert rendered_parts(spark, SF, "date").rdd.getNumPartitions() > 1


def test_hashed_vector_hashes_its_words_once(spark):
    plan = spark.range(1).select(values.hashed_vector(F.lit("a bc d"), 8, 12).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sha2(") == 1


def test_table_pieces_make_their_lines_once(spark):
    rows = spark.createDataFrame([(1, [["a"]])], "id long, t array<array<string>>")
    plan = rows.select(layout.table_pieces(F.col("t"), 8).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") == 2  # the cells of a line, the lines of a piece


def test_keywords_are_counted_inside_rows(spark):
    """Texts of their own ids send no words; those that share an id are counted together, with the same rows."""
    texts = ["Beta alpha beta, the x ab gamma-2 alpha", "zeta Zeta eta", "", None, "and the", "ñandú 3abc abc ñandú"]
    words = [[w for w in re.findall(r"[^\W\d_](?:[^\W_]|-){2,}", (t or "").lower()) if w not in text.STOPWORDS] for t in texts]
    apart = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    shared = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "id long, text string")
    for docs, ids in ((apart, range(6)), (shared, (0, 1))):
        want = []
        for i in ids:
            counts = Counter(w for k, ws in enumerate(words) if (k if docs is apart else k % 2) == i for w in ws)
            want += [(i, w, n) for w, n in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:2]]
        found = text.keywords(docs, 2)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert found.dtypes == [("id", "bigint"), ("term", "string"), ("n", "bigint")]
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (docs is shared)
