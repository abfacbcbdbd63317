"""Helpers shared by the corpus operators: the shared folder, stored tables, reading inputs."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (0x20 and 0x09-0x0D), as a regular-expression class body.
BLANKS = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent and the master is local (tests in one JVM) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="deskflume-")
    return f"{base.rstrip('/')}/deskflume-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there."""
    path = f"{folder}/{name}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Hands memory that this Python worker no longer uses back to the system.

    Workers live on from stage to stage, and what their allocators keep counts for the executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run):
    """``run``, a generator over batches, followed by ``release_memory``."""

    @functools.wraps(run)
    def released(batches):
        yield from run(batches)
        release_memory()

    return released


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken, base: str) -> str:
    """A column name that ``taken`` (column names, in any case) does not hold."""
    used = {c.lower() for c in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def joined_by_rows(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join; ``right`` has one row a key, whose column ``rows`` counts its rows among the
    ``total`` of ``left``.

    Keys with more than a partition's share of all rows are fewer than there are partitions, so
    they are broadcast at any input and their rows stay where they are; the rest is shuffled.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = F.col(rows) * n > total
    hot, cold = right.where(frequent).drop(rows), right.where(~frequent).drop(rows)
    apart = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(apart.join(cold, key))
