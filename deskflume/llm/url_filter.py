"""Operator 12: URL filters by host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the
rule's. Each URL is expanded into expressions, a suffix of its host followed by a prefix of its path;
expressions meet rules by an equi-join on the first 8 hex digits of their SHA-256, and then the full
digests are compared. Of the rules that fit the longest wins (host and path together, then the longer
host, then block before allow); without one the verdict is ``default``.

Only lengths that occur are expanded: host suffixes of as many labels, and path prefixes of as many
code points, as some rule has (one number for each distinct length comes to the driver, bounded by
the longest rule).

Scale: what no rule can look at is cut away first, so URLs fall into few classes, and the expansion
runs once for each distinct class (partially aggregated before its shuffle). Rules are broadcast where
``SMALL`` bytes hold them, counted first; else expressions are shuffled by hash prefix, those with more
than a partition's share by broadcast of their few rules. Classes with a rule go back to the
pages in the same way, by broadcast under SMALL bytes, else by class with the frequent ones broadcast;
pages whose class has no rule stay where they are in the first case.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; A-Z
of hosts are lower-cased, nothing else is normalised (ports and user names stay part of the host); rules
without host, or with a null in it, fit nothing, a null path is an empty one; of equal rules block wins;
repeated pages are judged each; other columns are kept; empty tables give no rows, no rules the default.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined_by_rows, shared_folder, stored

#: Bytes of rules, or of judged classes, up to which they are broadcast.
SMALL = 32 << 20
PREFIX = 8
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lowered(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _lengths(rules: DataFrame, value: Column) -> list[int]:
    return sorted(r[0] for r in rules.select(value).distinct().collect())


def _expressions(classes: DataFrame, suffixes: list[int], prefixes: list[int]) -> DataFrame:
    """(host, path, digest) of ``classes``: one row for each host suffix and path prefix."""
    hosts = F.array(*[F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in suffixes])
    paths = F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in prefixes])
    some = classes.where("host <> ''").withColumn("suffix", F.explode(F.array_compact(hosts))).withColumn("start", F.explode(F.array_compact(paths)))
    return some.select("host", "path", F.sha2(F.concat("suffix", "start"), 256).alias("digest"))


def _bytes(df: DataFrame, *columns: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(100)))).first()[0] or 0


def judge(pages: DataFrame, rules: DataFrame, url="url", default="allow") -> DataFrame:
    """``pages`` with a struct column ``url_verdict``: host, path, rule (host and path, or null), verdict."""
    folder = shared_folder(pages.sparkSession)
    known = rules.select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' AND verdict IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("first"), "verdict")).alias("best"))
    known = known.select(F.concat("host", "path").alias("rule"), "best.verdict", "host", "path", F.sha2(F.concat("host", "path"), 256).alias("digest"))
    known = stored(known, folder, "rules")
    suffixes, prefixes = _lengths(known, labels(F.col("host"))), _lengths(known, F.length("path"))
    out = fresh(pages.columns, "url_verdict")
    host, path = host_and_path(F.col(url))
    names = {c: fresh([*pages.columns, out], f"uf_{c}") for c in ("url", "host", "path", "rule", "verdict")}
    parsed = pages.withColumn(names["url"], F.struct(host.alias("host"), path.alias("path")))

    def cut(x: str) -> list[Column]:
        """What rules can look at of host and path."""
        return [F.substring_index(f"{x}.host", ".", -max(suffixes, default=1)), F.left(F.col(f"{x}.path"), F.lit(max(prefixes, default=0)))]

    seen = parsed.select(*[c.alias(n) for c, n in zip(cut(names["url"]), ("host", "path"), strict=True)]).groupBy("host", "path").agg(F.count("*").alias("rows"))
    classes = stored(seen, folder, "classes")
    found = _expressions(classes, suffixes, prefixes) if suffixes else classes.where("false").select("host", "path", F.lit("").alias("digest"))
    found = found.withColumn("short", F.left("digest", F.lit(PREFIX)))
    own = known.select(F.left("digest", F.lit(PREFIX)).alias("short"), F.struct("digest", "rule", F.length("host").alias("n"), "verdict").alias("r"))
    if _bytes(known, "rule", "host", "path") <= SMALL:
        met = found.join(F.broadcast(own), "short")
    else:
        found = stored(found, folder, "expressions")
        uses = found.groupBy("short").agg(F.count("*").alias("uses"))
        lists = own.groupBy("short").agg(F.collect_list("r").alias("rs"))  # rules of one hash prefix: few
        met = joined_by_rows(found, lists.join(uses, "short"), "short", "uses", found.count()).withColumn("r", F.explode("rs"))
    fits = met.where("digest = r.digest").select("host", "path", F.struct(F.length("r.rule").alias("length"), "r.n", "r.rule", "r.verdict").alias("r"))
    best = stored(fits.groupBy("host", "path").agg(F.max("r").alias("r")).select("host", "path", "r.rule", "r.verdict"), folder, "best")

    key = [F.coalesce(c, F.lit("")) for c in cut(names["url"])]
    keyed = parsed.withColumn(names["host"], key[0]).withColumn(names["path"], key[1])
    on = [names["host"], names["path"]]
    judged = best.select(*[F.col(a).alias(names[a]) for a in ("host", "path", "rule", "verdict")])
    if _bytes(best, "host", "path", "rule", "verdict") <= SMALL:
        ruled = keyed.join(F.broadcast(judged), on, "left")
    else:
        place = fresh([*keyed.columns, *judged.columns], "uf_place")
        rows = fresh([*keyed.columns, *judged.columns, place], "uf_rows")
        every = classes.select(F.col("host").alias(names["host"]), F.col("path").alias(names["path"]), F.col("rows").alias(rows)).join(judged, on, "left")
        one = every.select(F.struct(*on).alias(place), names["rule"], names["verdict"], rows)
        ruled = joined_by_rows(keyed.withColumn(place, F.struct(*on)), one, place, rows, classes.agg(F.sum("rows")).first()[0] or 0)
    verdict = F.struct(F.col(names["url"])["host"].alias("host"), F.col(names["url"])["path"].alias("path"), F.col(names["rule"]).alias("rule"), F.coalesce(names["verdict"], F.lit(default)).alias("verdict"))
    return ruled.select(*[F.col(f"`{c}`") for c in pages.columns], verdict.alias(out))


def op12(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "url_verdict.*")


#: The same rows by DuckDB.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT host, path, h || q AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || q) DESC) AS place
         FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.place = 1
"""
