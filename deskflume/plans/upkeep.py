"""Queries of a catalogue's upkeep, and the same rows as SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import upkeep as U
from ..tables import table

C = F.col
CRAWLS = 6


def listings(s, d):
    """Customers as listed tables in six crawls; which crawl lists and reads which is arithmetic."""
    k, g = C("c_custkey"), C("crawl")
    grid = table(s, d, "customer").select(k, F.explode(F.sequence(F.lit(1), F.lit(CRAWLS))).alias("crawl"))
    return grid.where((k * 7 + g * g) % 5 > 0).select((g * 10).alias("crawl"), k.alias("name"), ((k + g) % 6 > 0).alias("readable"))


def spans(s, d):
    rows = listings(s, d)
    return U.presence_spans(rows, rows.select("crawl"))


def retired(s, d):
    """Edges between customers of neighbouring keys, without those that touch a table which is not there."""
    k = C("c_custkey")
    edges = table(s, d, "customer").select(k.alias("a"), (k + 1).alias("b"), ((k % 9 + 1) / 10).alias("weight"))
    return U.weighed(edges, U.present_state(spans(s, d)))


def due(s, d):
    k = C("p_partkey")
    state, values = (F.get(F.array(*map(F.lit, names)), (k / n % len(names)).cast("int")) for names, n in ((("PROFILED", "UNREADABLE", "DROPPED"), 1), (("COMPLETE", "PARTIAL", "ABSENT"), 3)))
    return table(s, d, "part").select("p_partkey", U.tier2_due(k % 11 == 0, F.sha2("p_type", 256), F.sha2(F.concat("p_type", F.when(k % 7 == 0, "x").otherwise("")), 256), state, C("p_size"), values).alias("due"))


def budget(s, d):
    k = C("p_partkey")
    rows = table(s, d, "part").select(F.concat("p_brand", F.lit("."), k).alias("name"), C("p_size").alias("pages"), F.get(F.array(F.lit(None), F.lit("ABSENT"), F.lit("PARTIAL"), F.lit("COMPLETE")), (k % 4).cast("int")).alias("values"), (C("p_size") * 90).alias("millis"), (C("p_size") * 25).alias("rows"), (C("p_size").cast("long") * 65_000).alias("bytes"))
    return U.admitted(rows)


def fates(s, d):
    """Some nations go, with their customers, these ones' orders and line items; cited customers stay as tombstones."""
    names = {"nation": ["n_nationkey"], "customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    tables = {n: table(s, d, n).select(*cs) for n, cs in names.items()}
    links = [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    cited = table(s, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    out = U.cascade(tables, links, {"nation": C("n_nationkey") % 5 == 2, "orders": C("o_orderkey") % 13 == 0}, {"customer": cited})
    counted = [df.groupBy("fate").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.coalesce("fate", F.lit("kept")).alias("fate"), "n") for n, df in out.items()]
    return reduce(DataFrame.union, counted)


QUERIES = {"F11_presence": spans, "F15_retired_edges": retired, "F12_tier2_due": due, "T8_budgeted": budget, "F13_cascade": fates}

_GRID = f"""grid AS (SELECT c_custkey AS name, g, (c_custkey * 7 + g * g) % 5 > 0 AS listed, (c_custkey + g) % 6 > 0 AS readable FROM customer, range(1, {CRAWLS} + 1) r(g)),
states AS (SELECT name, g, CASE WHEN NOT listed THEN 'DROPPED' WHEN readable THEN 'OK' ELSE 'UNREADABLE' END AS state FROM grid QUALIFY max(listed::INT) OVER (PARTITION BY name ORDER BY g) = 1),
runs AS (SELECT *, g - row_number() OVER (PARTITION BY name, state ORDER BY g) AS run FROM states),
spans AS (SELECT name, state, min(g)::INT AS first, max(g)::INT AS last FROM runs GROUP BY name, state, run)"""
ORACLES = {
    "F11_presence": f"WITH {_GRID} SELECT * FROM spans",
    "F15_retired_edges": f"""WITH {_GRID}, bad AS (SELECT name FROM states WHERE g = {CRAWLS} AND state <> 'OK')
      SELECT c_custkey AS a, c_custkey + 1 AS b, (c_custkey % 9 + 1) / 10.0::DOUBLE AS weight, CASE WHEN c_custkey IN (FROM bad) OR c_custkey + 1 IN (FROM bad) THEN 0 ELSE (c_custkey % 9 + 1) / 10.0::DOUBLE END::DOUBLE AS shown FROM customer""",
    "F12_tier2_due": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false ELSE p_size >= 30 OR p_partkey // 3 % 3 <> 0 END AS due FROM part""",
    "T8_budgeted": """WITH o AS (SELECT p_brand || '.' || p_partkey AS name, row_number() OVER w AS place, sum(p_size * 90) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, sum(p_size * 25) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r, sum(p_size::BIGINT * 65000) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
        FROM part WINDOW w AS (ORDER BY p_size, p_partkey % 4 > 1, p_brand || '.' || p_partkey))
      SELECT name, place::BIGINT AS place, CASE WHEN m > 120000 THEN 'WALL_CLOCK' WHEN r > 50000 THEN 'ROWS' WHEN b > 104857600 THEN 'BYTES' END AS stopped FROM o""",
    "F13_cascade": """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 2 THEN CASE WHEN c_acctbal > 5000 THEN 'tombstone' ELSE 'gone' END ELSE 'kept' END AS fate FROM customer),
      o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_custkey IN (SELECT c_custkey FROM c WHERE fate <> 'kept') THEN 'gone' ELSE 'kept' END AS fate FROM orders),
      l AS (SELECT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM o WHERE fate <> 'kept') THEN 'gone' ELSE 'kept' END AS fate FROM lineitem)
      SELECT name, fate, count(*)::BIGINT AS n FROM (SELECT 'nation' AS name, CASE WHEN n_nationkey % 5 = 2 THEN 'gone' ELSE 'kept' END AS fate FROM nation UNION ALL SELECT 'customer', fate FROM c UNION ALL SELECT 'orders', fate FROM o UNION ALL SELECT 'lineitem', fate FROM l) GROUP BY ALL""",
}
