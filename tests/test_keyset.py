import sqlite3

import pytest
from pyspark.sql import functions as F

from deskflume.sources import keyset

SCHEMA = "id long, name string, size double"


def put(path, ids):
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE IF NOT EXISTS "the ""rows" (id INTEGER, name TEXT, size REAL, other TEXT)')
        c.executemany('INSERT INTO "the ""rows" VALUES (?, ?, ?, ?)', [(i, None if i % 5 == 0 else f"n{i}", i / 2, "x") for i in ids])


def options(path, **more):
    return {"target": str(path), "table": 'the "rows', "key": "id", "page": "100", **more}


def test_batch_pages_and_cap(spark, tmp_path):
    spark.dataSource.register(keyset.KeysetSource)
    path = tmp_path / "db"
    put(path, [])
    read = spark.read.format("keyset").schema(SCHEMA)
    assert read.options(**options(path)).load().count() == 0
    put(path, [*range(250, 0, -1), *range(1000, 1050)])
    with sqlite3.connect(path) as c:
        c.execute('INSERT INTO "the ""rows" VALUES (NULL, ?, 1, ?)', ("lost", "x"))
    rows = read.options(**options(path)).load()
    assert rows.rdd.getNumPartitions() == 3 and rows.select("id").distinct().count() == rows.count() == 300
    assert rows.where("name IS NULL").count() == 60 and rows.agg(F.sum("size")).first()[0] == (sum(range(251)) + sum(range(1000, 1050))) / 2
    with pytest.raises(Exception, match="300 rows where 299 are allowed"):
        read.options(**options(path, most="299")).load().count()


def test_stream_goes_on_behind_the_last_whole_batch(spark, tmp_path):
    spark.dataSource.register(keyset.KeysetSource)
    path, seen = tmp_path / "db", []

    def crawl(fail=False):
        def write(batch, number):
            got = [r.id for r in batch.collect()]
            if fail:
                raise RuntimeError("lost")
            seen.append(got)

        stream = spark.readStream.format("keyset").schema(SCHEMA).options(**options(path)).load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    put(path, range(1, 251))
    crawl()
    put(path, range(251, 300))
    with pytest.raises(Exception, match="lost"):
        crawl(fail=True)
    put(path, range(300, 420))
    crawl()
    crawl()
    assert sorted(i for batch in seen for i in batch) == list(range(1, 420))
