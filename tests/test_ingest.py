import shutil

from pyspark.sql import functions as F

from deskflume.streaming import ingest

SCHEMA = "id long, at long, text string, note string"


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def tables(spark, folder):
    return {t: rows_of(ingest.current(spark, folder, t)) for t in ingest.TABLES}


def plain(spark, docs):
    chunks = ingest.chunks_of(spark.createDataFrame([d for d in docs.items() if d[1] is not None] or [(0, "")], "id long, text string"))
    return {
        "documents": sorted((str(i), r[0]) for i, t in docs.items() if t is not None for r in [spark.createDataFrame([(t,)], "t string").select(F.sha2("t", 256)).first()]),
        "chunks": rows_of(chunks), "facts": rows_of(ingest.facts_of(chunks)),
    }


def test_ingest_recomputes_what_changed_and_replays_are_the_same(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(source), folder, checkpoint).awaitTermination(180)

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()

    long_ = "# Head\nPaid USD 12.50 on 2024-05-06.\n\n" + ("word " * 60 + "\n\n") * 8 + "# Next\nSee INV-2024-113, 3 kg."
    add((1, 1, long_, "x"), (2, 1, "Due in 5 days", "x"), (3, 1, "", "x"), (2, 0, "older row", "x"))
    docs = {1: long_, 2: "Due in 5 days", 3: ""}
    assert tables(spark, folder) == plain(spark, docs)
    add((1, 2, long_, "same"), (2, 2, "Due in 6 weeks, EUR 5", "new"), (4, 1, None, "x"))
    docs[2] = "Due in 6 weeks, EUR 5"
    assert tables(spark, folder) == plain(spark, docs)
    second = spark.read.parquet(f"{folder}/documents/batch=1")
    assert {r.id for r in second.collect()} == {2}  # what had not changed was not computed again
    add((1, 3, None, "gone"), (3, 3, "now 7 GB", "x"))
    docs.update({1: None, 3: "now 7 GB"})
    state = tables(spark, folder)
    assert state == plain(spark, docs)

    # the last batch runs again, as after a crash before its commit
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    shutil.rmtree(f"{folder}/facts/batch={commits[-1].name}")
    run()
    assert tables(spark, folder) == state
    ingest.compacted(spark, folder, str(tmp_path / "small"))
    assert tables(spark, str(tmp_path / "small")) == state
