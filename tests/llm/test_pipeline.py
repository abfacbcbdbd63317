import duckdb
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against a plain version of it over its own input."""
    from tests.llm.test_operators import components, encoder, sha

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, inputs[-1], SF)
        assert out.columns == columns, k
        inputs.append(spark.createDataFrame(out.collect(), docs.schema))
    rows = [x.collect() for x in inputs]
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if any(c.isalpha() for c in r.text or "")}
    assert all(r.n_chars == len(r.text) for r in rows[2]) and len(rows[2]) == len(rows[1])
    kept = {i for i, (_, _, keep) in components([(r.doc_id, r.text) for r in rows[2]], 5).items() if keep}
    assert {r.doc_id for r in rows[3]} == kept
    assert {r.doc_id for r in rows[4]} <= kept
    enc = encoder()
    want = sorted((r.doc_id, sha(",".join(map(str, enc.encode_ordinary(r.text or ""))))) for r in rows[4])
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, inputs[-1], SF).collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_unlabelled_documents_stay(spark):
    """With no labelled row to learn from, the language stage drops only what has no letters."""
    from deskflume.llm.lang_id import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 34 !", "en", "s", 7), (None, "Слова есть", "ru", "s", 10)], docs.schema)
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    unlabelled = docs.union(odd).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    only_held_out = docs.union(odd).withColumn("lang", F.when(held_out(F.col("doc_id")), F.col("lang")))
    for rows in (unlabelled, only_held_out):
        got = corpus_pipeline.STAGES[0][1](spark, rows, SF)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == lettered | {None}


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op6_line_dedup", "op9_source_mix", "op11_merkle_manifest", "op12_url_filter"])
def test_sql_gives_the_same_rows(spark, name):
    from deskflume.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[want.columns]
    a, b = (x.sort_values(x.columns[0] if "doc_id" not in x else "doc_id").reset_index(drop=True) for x in (got, want))
    assert list(got.columns) and len(a) == len(b)
    for c in want.columns:
        assert (a[c].fillna("") == b[c].fillna("")).all() or (a[c] - b[c]).abs().max() < 1e-6, c
