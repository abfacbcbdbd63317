"""Queries of edges between datasets and between documents, and the same rows as SQL."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import edges as E
from ..operators import graph as G
from ..tables import table
from .knowledge import _KEYWORDS, keyword_sets

SALT = "desk"
col = F.col


def _named(prefix, key):
    return F.concat(F.lit(prefix), col(key).cast("string"))


def values(s, d):
    """Customers and suppliers by nation and orders by priority as datasets, with some of their columns as fields."""
    customers = E.field_values(table(s, d, "customer"), _named("customer ", "c_nationkey"), segment=col("c_mktsegment"), key=col("c_custkey"))
    suppliers = E.field_values(table(s, d, "supplier"), _named("supplier ", "s_nationkey"), key=col("s_suppkey"))
    orders = E.field_values(table(s, d, "orders"), _named("orders ", "o_orderpriority"), status=col("o_orderstatus"), customer=col("o_custkey"))
    return customers.union(suppliers).union(orders)


def signatures(s, d):
    return E.signatures(values(s, d), SALT)


def contained(s, d):
    sigs = signatures(s, d)
    return E.containments(E.candidates(E.bands(sigs)), sigs).select("a", "b", "fa", "fb", "jaccard", F.round("a_in_b", 6).alias("a_in_b"), F.round("b_in_a", 6).alias("b_in_a"))


def dataset_edges(s, d):
    v = values(s, d)
    names = v.select("dataset").distinct().select("dataset", col("dataset").alias("name"))
    spans = table(s, d, "orders").groupBy(_named("orders ", "o_orderpriority").alias("dataset")).agg(F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"))
    declared = names.where("dataset LIKE 'supplier %'").select(col("dataset").alias("a"), F.regexp_replace("dataset", "supplier", "customer").alias("b")).join(names.select(col("dataset").alias("b")), "b", "left_semi").select("a", "b")
    entities = v.where("field IN ('segment', 'status')").select("dataset", col("value").alias("entity"))
    return E.dataset_edges(v, SALT, names, spans, entities, declared)


def pairs_compared(s, d):
    v = values(s, d)
    n = F.count("*")
    naive = v.select("dataset").distinct().agg((n * (n - 1) / 2).cast("long").alias("naive"))
    return E.candidates(E.bands(E.signatures(v, SALT))).agg(n.alias("compared")).join(F.broadcast(naive))  # one row each


def related(s, d):
    """The 20 nodes that weigh most beside supplier 1 of the graph of parts and suppliers, without every seventh part."""
    edges = table(s, d, "lineitem").select(col("l_partkey").alias("a"), (-col("l_suppkey")).alias("b"), col("l_extendedprice").alias("weight"))
    return G.related(edges, table(s, d, "part").where("p_partkey % 7 <> 0").select(col("p_partkey").alias("id")), -1, 20)


def view_nodes(s, d):
    """Nodes of the graph view: nations, and the suppliers that readers may see, with the number of line items below."""
    held = table(s, d, "lineitem").groupBy(col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("size"))
    leaf = table(s, d, "supplier").where("s_acctbal > 0").join(held, "s_suppkey", "left").select("s_nationkey", "s_suppkey", F.coalesce("size", F.lit(0)).alias("size"))
    nations = leaf.groupBy("s_nationkey").agg(F.sum("size").alias("size")).select(F.lit("collection").alias("kind"), col("s_nationkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), "size")
    return nations.union(leaf.select(F.lit("document"), "s_suppkey", col("s_nationkey").cast("long"), "size"))


QUERIES = {
    "Fh2_signatures": lambda s, d: signatures(s, d).select("dataset", "field", "n", F.array_join(col("sig").cast("array<string>"), ",").alias("sig")),
    "Fh3_band_keys": lambda s, d: E.bands(signatures(s, d)).select("dataset", "field", "band", "key"),
    "Fh4_containment": contained,
    "J14_band_pairs": lambda s, d: E.candidates(E.bands(signatures(s, d))),
    "F8_dataset_edges": dataset_edges,
    "F9_pairs_compared": pairs_compared,
    "J13_name_affinity": lambda s, d: E.name_edges(table(s, d, "part").select(col("p_name").alias("dataset"), col("p_name").alias("name")).distinct()).select("a", "b", F.round("weight", 6).alias("weight")),
    "J15_keyword_classes": lambda s, d: C.classes(keyword_sets(s, d)).select("id", "class"),
    "T3_related": related,
    "G4_view_nodes": view_nodes,
}

_PERMUTATIONS = ", ".join(str((i, *E.constants(i))) for i in range(E.PERMUTATIONS))
_2_32 = "4294967296"
_SIGS = f"""v AS (SELECT DISTINCT * FROM (SELECT 'customer ' || c_nationkey AS dataset, 'segment' AS field, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'customer ' || c_nationkey, 'key', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'supplier ' || s_nationkey, 'key', s_suppkey::VARCHAR FROM supplier
  UNION ALL SELECT 'orders ' || o_orderpriority, 'status', o_orderstatus FROM orders UNION ALL SELECT 'orders ' || o_orderpriority, 'customer', o_custkey::VARCHAR FROM orders)),
h AS (SELECT dataset, field, sha256('{SALT}' || chr(0) || value) AS h FROM v), p(i, a, b, c, d) AS (VALUES {_PERMUTATIONS}),
x1 AS (SELECT dataset, field, i, d, ((('0x' || h[1:8])::BIGINT::HUGEINT * a + ('0x' || h[9:16])::BIGINT::HUGEINT * b + c) % {_2_32})::BIGINT AS x FROM h, p),
x2 AS (SELECT dataset, field, i, d, ((xor(x, x >> 16)::HUGEINT * {0x85EBCA6B}) % {_2_32})::BIGINT AS x FROM x1),
x3 AS (SELECT dataset, field, i, d, ((xor(x, x >> 13)::HUGEINT * {0xC2B2AE35}) % {_2_32})::BIGINT AS x FROM x2),
rows_ AS (SELECT dataset, field, i, min((xor(x, x >> 16) + d) % {_2_32})::BIGINT AS m FROM x3 GROUP BY ALL),
sizes AS (SELECT dataset, field, count(*)::BIGINT AS n FROM v GROUP BY ALL),
sigs AS (SELECT dataset, field, n, list(m ORDER BY i) AS sig FROM rows_ JOIN sizes USING (dataset, field) GROUP BY ALL),
bands AS (SELECT dataset, field, band::INT AS band, sha1(array_to_string(sig[8 * band + 1 : 8 * band + 8], ','))[1:16] AS key FROM sigs, range(16) t(band)),
pairs AS (SELECT DISTINCT x.dataset AS a, y.dataset AS b FROM bands x JOIN bands y ON x.key = y.key AND x.dataset < y.dataset)"""
_CONTAINED = f"""{_SIGS}, j AS (SELECT p.a, p.b, x.field AS fa, y.field AS fb, x.n AS na, y.n AS nb, len(list_filter(list_zip(x.sig, y.sig), lambda e: e[1] = e[2])) / 128.0::DOUBLE AS jaccard
  FROM pairs p JOIN sigs x ON x.dataset = p.a JOIN sigs y ON y.dataset = p.b),
cont AS (SELECT a, b, fa, fb, jaccard, least(jaccard * (na + nb) / (1 + jaccard) / na, 1)::DOUBLE AS a_in_b, least(jaccard * (na + nb) / (1 + jaccard) / nb, 1)::DOUBLE AS b_in_a FROM j)"""

ORACLES = {
    "Fh2_signatures": f"WITH {_SIGS} SELECT dataset, field, n, array_to_string(sig, ',') AS sig FROM sigs",
    "Fh3_band_keys": f"WITH {_SIGS} SELECT * FROM bands",
    "Fh4_containment": f"WITH {_CONTAINED} SELECT a, b, fa, fb, jaccard, round(a_in_b, 6) AS a_in_b, round(b_in_a, 6) AS b_in_a FROM cont",
    "J14_band_pairs": f"WITH {_SIGS} SELECT * FROM pairs",
    "F9_pairs_compared": f"WITH {_SIGS}, n AS (SELECT count(DISTINCT dataset) AS n FROM v) SELECT (SELECT count(*) FROM pairs)::BIGINT AS compared, (n * (n - 1) // 2)::BIGINT AS naive FROM n",
    "F8_dataset_edges": f"""WITH {_CONTAINED}, f AS (SELECT dataset, list(DISTINCT field) AS f FROM v GROUP BY 1), n AS (SELECT count(*) AS n FROM f),
      best AS (SELECT a, b, max(least(a_in_b, b_in_a)) FILTER (least(a_in_b, b_in_a) > 0.9) AS both_, max(greatest(a_in_b, b_in_a)) AS one FROM cont GROUP BY ALL),
      al AS (SELECT x.dataset AS a, y.dataset AS b, len(list_intersect(x.f, y.f))::DOUBLE / len(list_distinct(list_concat(x.f, y.f))) AS alike FROM f x JOIN f y ON x.dataset < y.dataset),
      ent AS (SELECT DISTINCT dataset, value FROM v WHERE field IN ('segment', 'status')), df AS (SELECT value, count(*)::DOUBLE / (SELECT n FROM n) AS share FROM ent GROUP BY 1),
      sp AS (SELECT 'orders ' || o_orderpriority AS dataset, epoch_us(min(o_orderdate)) AS t0, epoch_us(max(o_orderdate)) AS t1 FROM orders GROUP BY 1),
      e AS (SELECT replace(dataset, 'customer', 'supplier') AS a, dataset AS b, 'DECLARED_FK' AS kind, 1.0::DOUBLE AS weight FROM f WHERE dataset LIKE 'customer %' AND replace(dataset, 'customer', 'supplier') IN (SELECT dataset FROM f)
        UNION ALL SELECT a, b, 'NEAR_DUPLICATE', 0.9::DOUBLE * both_ * alike FROM best JOIN al USING (a, b) WHERE both_ IS NOT NULL AND alike > 0.9
        UNION ALL SELECT a, b, 'SHARED_VALUES', 0.85::DOUBLE * one FROM best
        UNION ALL SELECT x.dataset, y.dataset, 'SHARED_ENTITY', max(0.6::DOUBLE * CASE WHEN share <= 0.05 THEN 1 WHEN share <= 0.25 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END) FROM ent x JOIN ent y ON x.value = y.value AND x.dataset < y.dataset JOIN df ON df.value = x.value GROUP BY 1, 2
        UNION ALL SELECT a, b, 'NAME_AFFINITY', 0.35::DOUBLE * jaro_winkler_similarity(a, b) FROM al WHERE jaro_winkler_similarity(a, b) >= 0.9
        UNION ALL SELECT x.dataset, y.dataset, 'TEMPORAL_ALIGNMENT', 0.2::DOUBLE * greatest(least(x.t1, y.t1) - greatest(x.t0, y.t0), 0)::DOUBLE / (greatest(x.t1, y.t1) - least(x.t0, y.t0)) FROM sp x JOIN sp y ON x.dataset < y.dataset)
      SELECT a, b, kind, round(weight, 6) AS weight FROM e WHERE weight >= 0.1""",
    "J13_name_affinity": "WITH t AS (SELECT DISTINCT p_name AS t FROM part) SELECT x.t AS a, y.t AS b, round(0.35::DOUBLE * jaro_winkler_similarity(lower(x.t), lower(y.t)), 6) AS weight FROM t x JOIN t y ON x.t < y.t WHERE jaro_winkler_similarity(lower(x.t), lower(y.t)) >= 0.9",
    "J15_keyword_classes": f"WITH {_KEYWORDS}, s AS (SELECT id, list_sort(list(term)) AS ks FROM top GROUP BY id) SELECT id, min(id) OVER (PARTITION BY ks) AS class FROM s",
    "T3_related": "SELECT l_partkey AS id, max(l_extendedprice) AS weight FROM lineitem WHERE l_suppkey = 1 AND l_partkey % 7 <> 0 AND l_extendedprice > 0 AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1 ORDER BY weight DESC, id LIMIT 20",
    "G4_view_nodes": """WITH l AS (SELECT s_nationkey::BIGINT AS parent, s_suppkey AS id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT AS size FROM supplier WHERE s_acctbal > 0)
      SELECT 'collection' AS kind, parent AS id, NULL::BIGINT AS parent, sum(size)::BIGINT AS size FROM l GROUP BY parent UNION ALL SELECT 'document', id, parent, size FROM l""",
}
