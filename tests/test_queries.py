import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from deskflume.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.columns and got.count() > 0
        return
    want = duck.execute(ORACLES[name]).df()
    have = got.toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    numbers = {c: (pd.api.types.is_integer_dtype(have[c]), pd.api.types.is_integer_dtype(want[c])) for c in want if pd.api.types.is_numeric_dtype(want[c]) and not want[c].isna().any()}
    assert all(a == b for a, b in numbers.values()), numbers
    assert canonical(have) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
