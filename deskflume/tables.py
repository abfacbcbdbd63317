"""Tables of the driver, and desk records derived from them by fixed arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ["URGENT", "HIGH", "MEDIUM", "LOW"]
CATEGORIES = ["HARDWARE", "SOFTWARE", "NETWORK", "ACCESS", "EMAIL", "SECURITY", "OTHER"]
#: Minutes to the first response and to the resolution, by priority.
SLA_MINUTES = {"URGENT": (15, 240), "HIGH": (60, 480), "MEDIUM": (240, 1440), "LOW": (480, 4320)}
#: The moment at which desk queries look; no query reads a clock.
NOW = "2000-06-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def minutes_after(ts, minutes):
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def minutes_between(later, earlier):
    """Whole and partial minutes as a double."""
    return (F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(60_000_000)).cast("double")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tickets: id, requester, status (OPEN, PENDING, RESOLVED), priority, category, by_ai, times and due times."""
    key, made = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    level = F.get(F.array(*map(F.lit, ["URGENT", "HIGH", "MEDIUM", "MEDIUM", "LOW"])), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    base = table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("requester"),
        F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("OPEN").alias("status"),
        level.alias("priority"),
        F.get(F.array(*map(F.lit, CATEGORIES)), (key % 7).cast("int")).alias("category"),
        (key % 3 == 0).alias("by_ai"),
        made.alias("created"),
        F.when(key % 5 != 0, minutes_after(made, key % 600)).alias("first_response"),
    )
    policy = spark.createDataFrame([(p, *m) for p, m in SLA_MINUTES.items()], "priority string, respond int, resolve int")
    late = F.when(F.col("status") == "RESOLVED", minutes_after(F.col("created"), F.col("id") % 5000))
    return (
        base.join(F.broadcast(policy), "priority")  # four rows
        .withColumns({"resolved": late, "response_due": minutes_after(F.col("created"), F.col("respond")), "resolution_due": minutes_after(F.col("created"), F.col("resolve"))})
        .drop("respond", "resolve")
    )


#: The same tickets in DuckDB's SQL, as the beginning of a WITH clause.
TICKETS_SQL = f"""tickets AS (
  SELECT *, created + to_minutes(CASE priority WHEN 'URGENT' THEN 15 WHEN 'HIGH' THEN 60 WHEN 'MEDIUM' THEN 240 ELSE 480 END) AS response_due,
         created + to_minutes(CASE priority WHEN 'URGENT' THEN 240 WHEN 'HIGH' THEN 480 WHEN 'MEDIUM' THEN 1440 ELSE 4320 END) AS resolution_due
  FROM (SELECT o_orderkey AS id, o_custkey AS requester,
         CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'PENDING' ELSE 'OPEN' END AS status,
         ['URGENT', 'HIGH', 'MEDIUM', 'MEDIUM', 'LOW'][left(o_orderpriority, 1)::INT] AS priority,
         {CATEGORIES!r}[o_orderkey % 7 + 1] AS category, o_orderkey % 3 = 0 AS by_ai, o_orderdate::TIMESTAMP AS created,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 600)::INT) END AS first_response,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 5000)::INT) END AS resolved
  FROM orders))"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a library: id, owner, visibility, collection, data source and its state, all by arithmetic on doc_id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        (d % 11).alias("owner"),
        F.when(d % 4 == 0, "PUBLIC").when(d % 4 == 1, "STAFF").otherwise("PRIVATE").alias("visibility"),
        (d % 6).alias("collection"),
        F.when(d % 3 == 0, d % 5).alias("source_id"),
        (d % 17 == 0).alias("gone"),
        "text",
    )


LIBRARY_SQL = """library AS (SELECT doc_id AS id, doc_id % 11 AS owner, CASE doc_id % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'STAFF' ELSE 'PRIVATE' END AS visibility,
  doc_id % 6 AS collection, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END AS source_id, doc_id % 17 = 0 AS gone, text FROM documents)"""
