"""Incremental ingest: a stream of documents kept as chunks and facts, by the hash of their content.

Each micro-batch takes the newest row of every document, leaves out those whose content is as it was, and
writes the chunks and facts of the others under its number. A batch that runs again reads what was before
it and overwrites its own folders, so a replay leaves the same tables. What is current of a document is
what its last batch wrote; rows that it replaces stay in their folders until ``compacted`` copies what is current
to a new place.

Defined results: a null text takes a document's chunks and facts away; empty and blank texts have none; of rows
of one document and time in a batch the one with the greatest text counts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import text as T

TABLES = {
    "documents": "id long, hash string",
    "chunks": "id long, chunk int, first_line int, last_line int, text string",
    "facts": "id long, chunk int, start int, length int, kind string, norm string, unit string, confidence string",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[table]}, batch long").parquet(f"{folder}/{table}")


def _prepare(spark: SparkSession, folder: str) -> None:
    """Empty tables, so that the first batch finds some."""
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{table}/batch=-1")


def chunks_of(docs: DataFrame) -> DataFrame:
    """(id, chunk, first_line, last_line, text) of ``docs`` (id, text)."""
    found = docs.select("id", F.posexplode(T.markdown_chunks("text")).alias("chunk", "c"))
    return found.select("id", "chunk", F.col("c.first_line").cast("int").alias("first_line"), F.col("c.last_line").cast("int").alias("last_line"), "c.text")


def facts_of(chunks: DataFrame) -> DataFrame:
    """Facts by document, chunk and place."""
    rows = chunks.select(F.struct("id", "chunk").alias("id"), "text")
    return K.facts(rows).select("id.id", "id.chunk", "start", "length", "kind", "norm", "unit", "confidence")


def ingest(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query over a stream (id, at, text); ``current`` reads the tables."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max(F.struct("at", "text")).alias("row")).select("id", "row.text")
        hashed = newest.withColumn("hash", F.sha2("text", 256))
        known = _latest(_read(spark, folder, "documents").where(F.col("batch") < number)).select("id", F.col("hash").alias("old"))
        changed = hashed.join(known, "id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("id", "text", "hash")

        def put(rows: DataFrame, table: str) -> DataFrame:
            path = f"{folder}/{table}/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(TABLES[table]).parquet(path)

        changed = changed.persist()
        try:
            put(facts_of(put(chunks_of(changed.where("text IS NOT NULL")), "chunks")), "facts")
            put(changed.select("id", "hash"), "documents")  # last: the others are there when it says so
        finally:
            changed.unpersist()

    if not _exists(spark, f"{folder}/documents"):
        _prepare(spark, folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _latest(documents: DataFrame) -> DataFrame:
    """(id, batch, hash): the last batch that wrote each document."""
    return documents.groupBy("id").agg(F.max(F.struct("batch", "hash")).alias("d")).select("id", "d.batch", "d.hash")


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table that hold now."""
    last = _latest(_read(spark, folder, "documents"))
    if table == "documents":
        return last.where("hash IS NOT NULL").drop("batch")
    return _read(spark, folder, table).join(last.select("id", "batch"), ["id", "batch"], "left_semi").drop("batch")


def compacted(spark: SparkSession, folder: str, target: str) -> None:
    """Copies what is current to a new folder, from which the stream may go on with the same checkpoint."""
    last = _latest(_read(spark, folder, "documents"))
    top = last.agg(F.max("batch")).first()[0]
    for table, schema in TABLES.items():
        rows = last.where("hash IS NOT NULL").drop("batch") if table == "documents" else current(spark, folder, table)
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/{table}/batch=-1")
        rows.write.mode("overwrite").parquet(f"{target}/{table}/batch={top if top is not None else -1}")
