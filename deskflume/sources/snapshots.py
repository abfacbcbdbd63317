"""Incremental synchronisation: rows to documents, version diffs, upserts, deletion after a complete crawl."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmptyCrawl(ValueError):
    """A crawl without rows is an error, never an empty source."""


def rendered(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, text, version): a line ``column = value`` each, and the digest of the text."""
    lines = [F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return rows.select(F.col(key).alias("key"), F.concat_ws("\n", *lines).alias("text")).withColumn("version", F.sha2("text", 256))


def changes(stored: DataFrame, crawl: DataFrame, complete: bool = True) -> DataFrame:
    """(key, change): added, changed, unchanged and, after a complete crawl only, gone."""
    how = "full_outer" if complete else "right"
    both = stored.select("key", F.col("version").alias("old")).join(crawl.select("key", F.col("version").alias("new")), "key", how)
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("key", change.alias("change"))


def upserted(stored: DataFrame, crawl: DataFrame, complete: bool = True) -> DataFrame:
    """The stored table after a crawl, by one join; to be written to a new path. Rows of the same version stay as
    they were stored; after a complete crawl those that it lacks go."""
    if crawl.isEmpty():
        raise EmptyCrawl("the crawl has no rows")
    columns = stored.columns
    old, new = (df.select("key", F.struct(*columns).alias(n)) for df, n in ((stored, "old"), (crawl, "new")))
    both = old.join(new, "key", "right" if complete else "full_outer")
    same = F.col("new").isNull() | F.coalesce(F.col("old.version") == F.col("new.version"), F.lit(False))
    return both.select(F.when(same, F.col("old")).otherwise(F.col("new")).alias("row")).select("row.*")


def numbered(rows: DataFrame, order: list[str], above: int) -> DataFrame:
    """Numbers ``above`` + 1, ... in an order, without one global sort: counts of range partitions first."""
    from pyspark.sql import Window

    spread = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    return spread.join(F.broadcast(before), "part").withColumn("number", F.col("at") + F.col("before") + above).drop("part", "at", "before")


def files(spark, folder: str, pattern: str, most_bytes: int = 25 << 20) -> DataFrame:
    """(path, name, content_type, length, content) of files below a folder; larger ones are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.col("length") <= most_bytes).select("path", name.alias("name"), content_type(name).alias("content_type"), "length", "content")


#: Content types by extension.
TYPES = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "jsonl": "application/jsonl", "ndjson": "application/jsonl", "txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "parquet": "application/vnd.apache.parquet", "gz": "application/gzip", "zip": "application/zip", "html": "text/html", "xml": "application/xml",
}


def extension(name: Column) -> Column:
    """In lower case, without the dot; empty for none and for hidden files."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([A-Za-z0-9]+)$", 1))


def content_type(name: Column) -> Column:
    look = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.get(F.array(look), F.lit(0))[extension(name)], F.lit("application/octet-stream"))


def sniffed(content: Column) -> Column:
    """pdf, zip or text, by the first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.startswith("504B0304"), "zip").otherwise("text")


def scrubbed(message: Column) -> Column:
    """Without credentials in URLs and key-value pairs."""
    steps = [(r"://[^/\s:@]+:[^/\s@]+@", "://***@"), (r"(?i)(password|secret|token|key)=[^\s&]+", "$1=***")]
    return reduce(lambda m, s: F.regexp_replace(m, *s), steps, message)
