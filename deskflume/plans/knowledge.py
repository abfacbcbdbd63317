"""Knowledge, catalogue, graph and synchronisation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import text as T
from ..operators import access as A
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import search as S
from ..sources import snapshots as R
from ..tables import LIBRARY_SQL, library, table

USER, AGENT = 7, 2


def grants(spark, sf):
    """Grants by arithmetic: some documents to a user, collections to groups and an agent, sources to all three."""
    docs = table(spark, sf, "documents").where("doc_id % 13 = 3").select(F.lit("DOCUMENT").alias("target"), F.col("doc_id").alias("target_id"), F.lit("USER").alias("subject"), F.lit(USER).cast("long").alias("subject_id"))
    fixed = [("COLLECTION", 4, "GROUP", 2), ("COLLECTION", 5, "GROUP", 3), ("COLLECTION", 0, "AGENT", AGENT), ("COLLECTION", 4, "AGENT", AGENT), ("SOURCE", 0, "USER", USER), ("SOURCE", 1, "GROUP", 2), ("SOURCE", 3, "USER", USER), ("SOURCE", 0, "AGENT", AGENT)]
    return docs.union(spark.createDataFrame(fixed, "target string, target_id long, subject string, subject_id long"))


def access_args(spark, sf):
    groups = spark.createDataFrame([(USER, 2), (8, 3)], "user_id long, group_id long")
    return library(spark, sf), spark.createDataFrame([(0, "READY"), (1, "READY"), (2, "READY"), (3, "PURGED"), (4, "READY")], "source_id long, state string"), grants(spark, sf), groups


def entitled(spark, sf):
    lib, _, granted, groups = access_args(spark, sf)
    return A.entitled(lib, granted, groups, USER, True)


def readable(spark, sf, agent=None):
    return A.readable(*access_args(spark, sf), USER, True, agent)


def per_collection(spark, sf):
    return A.per_collection(library(spark, sf), readable(spark, sf))


def hybrid(spark, sf):
    """Readable texts with both terms, blended with the similarity of every readable vector to vector 3."""
    lib = library(spark, sf).join(readable(spark, sf), "id", "left_semi")
    vectors = table(spark, sf, "embeddings")
    near = S.similarities(vectors.join(lib.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), vectors, 3).withColumnRenamed("vec_id", "id")
    return S.blend(S.keyword_rank(lib, ["the", "and"]), near, 10)


def words(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def keyword_sets(spark, sf):
    """(id, tokens): the keywords of each document, eight at most, sorted."""
    top = T.keywords(words(spark, sf), 8)
    return top.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("tokens"))


def shelf(spark, sf):
    """Public documents without a collection whose name, keywords or topics hold a text."""
    d = F.col("id")
    topics = F.array(F.concat(F.lit("Topic "), d % 10), F.when(d % 8 == 0, "Erst"))
    lib = library(spark, sf).join(keyword_sets(spark, sf).withColumnRenamed("tokens", "keywords"), "id", "left")
    rows = lib.withColumns({"collection": F.when(d % 3 > 0, F.col("collection")), "name": F.concat(F.lit("Doc "), d, F.lit(".ER")), "topics": F.array_compact(topics)})
    searches = ((" ER ", "PUBLIC", "NONE"), ("erst", "ALL", "ALL"), ("topic 7", "STAFF", "1"), ("", "PRIVATE", "NONE"))
    asked = F.array_compact(F.array(*[F.when(A.filed(text, seen, where), F.lit(text)) for text, seen, where in searches]))
    return rows.select("id", F.explode(asked).alias("asked"))  # one pass, so keywords are made once


def keyword_edges(spark, sf):
    """Documents with two keywords in common or more, by classes of equal keywords (see J15_keyword_classes)."""
    return C.sharing_two(keyword_sets(spark, sf), lambda n: n / 10)


def benchmark_overlap(spark, sf):
    """Distinct words of benchmark items that documents hold, as containment of at least half. To hold half
    of n words a document must hold one of any n - ceil(n / 2) + 1 of them: items wait under that many, the
    longest first, which few documents have; the pairs that meet are counted on all words."""
    def held(name, key):
        split = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        return table(spark, sf, name).select(key, split.alias("w"))

    docs, items = held("documents", "doc_id"), held("benchmark", "item_id").where(F.size("w") > 0)
    longest = F.transform(F.array_sort(F.transform("w", lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w")))), lambda x: x["w"])
    waiting = items.select("item_id", F.explode(F.slice(longest, F.lit(1), F.floor(F.size("w") / 2).cast("int") + 1)).alias("word"))
    wanted = items.select("item_id", F.col("w").alias("asked"))
    met = docs.select("doc_id", F.explode("w").alias("word")).join(waiting, "word").select("doc_id", "item_id").distinct()
    lists = met.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))  # numbers of items that a text may hold; their words join behind the texts
    pairs = docs.join(lists, "doc_id").select("doc_id", "w", F.explode("items").alias("item_id")).join(wanted, "item_id")
    counted = F.struct("item_id", F.size(F.array_intersect("asked", "w")).cast("long").alias("common"), F.size("asked").alias("n"))
    pairs = pairs.select("doc_id", F.explode(F.array(counted)).alias("x")).where(F.round(F.col("x.common") / F.col("x.n"), 6) >= 0.5)
    return pairs.select("doc_id", "x.item_id", "x.common", F.round(F.col("x.common") / F.col("x.n"), 6).alias("containment"))


def rendered_orders(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.format_string("Invoice INV-2024-%05d for USD %.2f dated %s, due in %d days, mail buyer%d@example.org", F.col("o_orderkey"), F.floor("o_totalprice").cast("double"), "day", F.col("o_orderkey") % 60 + 2, "o_custkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text")).repartition(n, "id")  # facts cost far more than moving the rows of one small file


def rendered_parts(spark, sf, what):
    """Parts as sentences with facts in several shapes; the key decides the values."""
    k = F.col("p_partkey").cast("int")
    d, m, y = k % 28 + 1, k % 12 + 1, k % 30 + 1995
    english, spanish = (F.get(F.array(*map(F.lit, names)), m - 1) for names in K.MONTHS)
    dates = "on %04d-%02d-%02d; %d.%d.%d or %d/%d/%d; %dth %s %d; %s %d, %d; %d de %s de %d; in %s %d, Q%d %d, yesterday."
    shapes = {
        "date": F.format_string(dates, y, m, d, d, m, y + 40, m, d, y + 80, d, english, y + 120, F.initcap(english), d, y + 160, d, spanish, y + 200, english, y + 240, k % 4 + 1, y + 280),
        "money": F.format_string("pay $%d,%03d.50 or €%d,25, then EUR %d.%03d,75, CLP$%d.%03d, JPY %d and %d.5 GBP; CODE%d, 5 XXX", k % 900 + 1, k % 1000, k % 90, k % 900 + 1, k % 1000, k % 900 + 1, k % 1000, k % 5000, k % 70, k),
        "duration": F.format_string("%d days, PT%dH30M, P%dW2D, %d semanas y %dm; 2 months", k % 50 + 2, k % 20 + 1, k % 5 + 1, k % 9 + 2, k % 55),
        "quantity": F.format_string("%d kg, %d.50 GB, %d%% and %d,5 km but not v%d.%dm or %d kwh", k % 50, k % 16, k % 100, k % 70, k, k, k),
    }
    parts = table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # as rendered_orders
    return parts.select(F.col("p_partkey").alias("id"), shapes[what].alias("text"), F.date_add(F.lit("2026-01-01").cast("date"), k % 365).alias("day"))


def part_dates(spark, sf):
    return K.facts(rendered_parts(spark, sf, "date"), day="day").where("kind = 'DATE'")


def order_months(spark, sf):
    """The months that orders were made in, as windows of days."""
    month = F.trunc("o_orderdate", "month")
    months = table(spark, sf, "orders").select(month.alias("m")).distinct()
    return months.select(F.date_format("m", "yyyy-MM").alias("window"), (F.unix_date("m").cast("long") * K.DAY).alias("ts"), (F.unix_date(F.add_months("m", 1)).cast("long") * K.DAY).alias("ts_end"))


def two_hops(spark, sf):
    """From three parts to the suppliers that share line items with them, and on to those' parts."""
    supplier = (-F.col("l_suppkey")).alias("b")  # suppliers and parts are nodes of one graph
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), supplier, F.col("l_discount").alias("weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    parts, suppliers = table(spark, sf, "part").select(F.col("p_partkey").alias("id")), table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("id"))
    return G.two_hops(spark.range(3).select((F.col("id") + 1).alias("id")), edges, parts.union(suppliers).where("id % 7 <> 0"))


def snapshot(spark, sf, keep, shift):
    o = table(spark, sf, "orders").where(keep).withColumn("price", F.floor(F.col("o_totalprice")).cast("long") + shift)
    return R.rendered(o, "o_orderkey", ["o_orderkey", "o_orderstatus", "price"])


OLD, NEW = "o_orderkey % 10 <> 0", "o_orderkey % 10 <> 1"


def sync_changes(spark, sf):
    shift = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    return R.changes(snapshot(spark, sf, OLD, F.lit(0)), snapshot(spark, sf, NEW, shift)).groupBy("change").agg(F.count("*").alias("n"))


def sync_upsert(spark, sf):
    shift = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    return R.upserted(snapshot(spark, sf, OLD, F.lit(0)), snapshot(spark, sf, NEW, shift)).select("key", "version")


def url_prefixes(spark, sf):
    key = F.regexp_replace("url", "^https?://", "")
    return C.prefix_rollup(table(spark, sf, "pages").select(key.alias("key"), F.length("html").cast("long").alias("size")))


def sampled(spark, sf):
    rows = table(spark, sf, "documents").withColumn("digest", F.sha2(F.col("doc_id").cast("string"), 256))
    return C.ranked(rows, ["lang", "source"], [F.col("digest"), F.col("doc_id")], 2).select("doc_id", "lang", "source", "place")


def top_keyword_budget(spark, sf):
    rows = library(spark, sf).select("id", "collection", F.length("text").alias("size"))
    return T.budgeted(rows, "collection", [F.col("id")], F.col("size"), 20_000).select("id", "collection", "upto")


def furniture(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return T.furniture(lines, share=0.01)


def listed_columns(spark, sf, keep, shift):
    """A listing of columns (fqn, name, type): containers of parts as columns of their brands, the largest size
    as their type; parts left out, or larger, make the difference between two listings."""
    types = F.array(*map(F.lit, ("text", "integer", "numeric", "date")))
    largest = F.max(F.col("p_size") + F.when(F.col("p_partkey") % 10 == 3, shift).otherwise(0))
    p = table(spark, sf, "part").where(keep).groupBy(F.col("p_brand").alias("fqn"), F.col("p_type").alias("name")).agg(largest.alias("m"))
    return p.select("fqn", "name", F.get(types, (F.col("m") % 4).cast("int")).alias("type"))


def tier_drift(spark, sf):
    return C.drift(listed_columns(spark, sf, "p_partkey % 10 > 0 AND p_brand <> 'Brand#3'", 0), listed_columns(spark, sf, "p_partkey % 10 < 9 AND p_brand <> 'Brand#11'", 1))


def minhash_pairs(spark, sf):
    """Estimated against exact similarity of the word sets of each part's name and the next one's in its brand."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.array_distinct(F.split("p_name", "[ #]")).alias("w"))
    p = p.withColumn("sig", C.minhash(F.col("w"), 128))
    after = F.lead(F.struct("p_partkey", "w", "sig")).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = p.withColumn("next", after).where("next IS NOT NULL")
    return pairs.select(F.col("p_partkey").alias("a"), F.col("next.p_partkey").alias("b"), F.round(C.jaccard(F.col("w"), F.col("next.w")), 6).alias("exact"), C.estimated_jaccard(F.col("sig"), F.col("next.sig")).alias("estimate"))


def citations(spark, sf):
    """Orders as drafts' citations: three or so a draft, of documents and chunks by arithmetic."""
    k = F.col("o_orderkey")
    documents = table(spark, sf, "documents").count()
    return table(spark, sf, "orders").select(F.floor(k / 3).alias("draft"), (k % documents).alias("doc"), F.when(k % 4 > 0, k % 4 - 1).alias("chunk"))


def citation_check(spark, sf):
    lib, sources, _, _ = access_args(spark, sf)
    pieces = F.greatest(F.ceil(F.char_length("text") / 400), F.lit(1))
    chunks = lib.select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("chunk"))
    return A.citation_check(citations(spark, sf), lib, sources, readable(spark, sf, AGENT), chunks)


def name_affinity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(C.name_affinity(F.col("p_name"), F.col("p_type")), 6).alias("affinity"))


QUERIES = {
    "T1_hybrid_search": hybrid,
    "Fm1_nearest_vectors": lambda s, d: S.nearest(table(s, d, "embeddings"), 3, 10),
    "G6_entitled": entitled,
    "G6_readable": readable,
    "G6_readable_by_agent": lambda s, d: readable(s, d, AGENT),
    "A16_readable_per_collection": per_collection,
    "P8_shelf": shelf,
    "Fs1_keywords": lambda s, d: T.keywords(words(s, d), 8),
    "A23_keyword_profile": lambda s, d: T.profile(T.keywords(words(s, d), 8), 12),
    "Fs2_entities": lambda s, d: words(s, d).select("id", F.array_join(T.entities(F.col("text")), "|").alias("entities")).where("entities <> ''"),
    "Fs6_squeeze": lambda s, d: words(s, d).select("id", T.squeeze(F.col("text"), 80).alias("head")),
    "E6_furniture": furniture,
    "T11_char_budget": top_keyword_budget,
    "W3_hash_sample": sampled,
    "C8_facts": lambda s, d: K.facts(rendered_orders(s, d)).select("id", "kind", "norm"),
    "J4_fact_filters": lambda s, d: K.matching(K.facts(rendered_orders(s, d)), [("DURATION", "P10D"), ("EMAIL", "buyer7@example.org")]),
    "A25_fact_rarity": lambda s, d: K.rarity(K.facts(rendered_orders(s, d)), table(s, d, "orders").count()),
    "C1_dates": lambda s, d: part_dates(s, d).select("id", "norm", "ts", "ts_end", "confidence"),
    "C2_money": lambda s, d: K.facts(rendered_parts(s, d, "money")).where("kind = 'MONEY'").select("id", "norm", F.col("num").cast("long").alias("num"), "unit", "confidence"),
    "C3_durations": lambda s, d: K.facts(rendered_parts(s, d, "duration")).where("kind = 'DURATION'").select("id", "norm", F.col("num").cast("long").alias("num")),
    "C7_quantities": lambda s, d: K.facts(rendered_parts(s, d, "quantity")).where("kind = 'QUANTITY'").select("id", "norm", F.col("num").cast("double").alias("num"), "unit"),
    "C8_document_facts": lambda s, d: K.facts(words(s, d)).select("id", "kind", "start", "length", "norm", "confidence"),
    "P10_fact_windows": lambda s, d: K.overlapping(part_dates(s, d), order_months(s, d)),
    "E1_markdown_chunks": lambda s, d: words(s, d).select("id", F.explode(T.markdown_chunks("text")).alias("c")).select("id", "c.*"),
    "E9_html_text": lambda s, d: table(s, d, "pages").select("page_id", T.html_text("html").alias("text"), T.title(F.col("html")).alias("title")),
    "A20_column_shapes": lambda s, d: C.column_shapes(table(s, d, "customer")),
    "A21_frequent_values": lambda s, d: C.frequent_values(table(s, d, "lineitem"), "l_returnflag", 3, 5),
    "A22_prefix_rollup": url_prefixes,
    "U4_schema_drift": tier_drift,
    "Fm6_power_of_two": lambda s, d: table(s, d, "orders").select("o_orderkey", C.power_of_two(F.col("o_custkey")).alias("bucket")),
    "Fm8_interval_overlap": lambda s, d: table(s, d, "part").select("p_partkey", F.round(C.interval_overlap(F.col("p_size"), F.col("p_size") + 10, F.lit(20), F.lit(35)), 6).alias("overlap")),
    "J15_keyword_edges": keyword_edges,
    "J15_benchmark_overlap": benchmark_overlap,
    "U5_undirected_edges": lambda s, d: C.undirected(table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("weight"))),
    "G3_two_hops": two_hops,
    "Fh4_minhash_pairs": minhash_pairs,
    "J20_citation_check": citation_check,
    "Fs9_name_affinity": name_affinity,
    "R2_sync_changes": sync_changes,
    "S20_sync_upsert": sync_upsert,
    "R12_ticket_numbers": lambda s, d: R.numbered(table(s, d, "customer").select("c_custkey"), ["c_custkey"], 1000),
    "Fs16_content_types": lambda s, d: table(s, d, "pages").select("page_id", R.extension(F.col("url")).alias("extension"), R.content_type(F.col("url")).alias("content_type")),
}

_GRANTED = "(SELECT target, target_id FROM grants WHERE subject = 'USER' AND subject_id = 7 OR subject = 'GROUP' AND subject_id = 2)"
_ACCESS = f"""{LIBRARY_SQL},
grants AS (SELECT 'DOCUMENT' AS target, doc_id AS target_id, 'USER' AS subject, 7 AS subject_id FROM documents WHERE doc_id % 13 = 3 UNION ALL
  SELECT * FROM (VALUES ('COLLECTION', 4, 'GROUP', 2), ('COLLECTION', 5, 'GROUP', 3), ('COLLECTION', 0, 'AGENT', 2), ('COLLECTION', 4, 'AGENT', 2), ('SOURCE', 0, 'USER', 7), ('SOURCE', 1, 'GROUP', 2), ('SOURCE', 3, 'USER', 7), ('SOURCE', 0, 'AGENT', 2))),
mine AS {_GRANTED},
entitled AS (SELECT id FROM library WHERE owner = 7 OR visibility <> 'PRIVATE' OR id IN (SELECT target_id FROM mine WHERE target = 'DOCUMENT') OR collection IN (SELECT target_id FROM mine WHERE target = 'COLLECTION')),
readable AS (SELECT id FROM library WHERE id IN (SELECT id FROM entitled) AND (source_id IS NULL OR NOT gone AND source_id <> 3 AND source_id IN (SELECT target_id FROM mine WHERE target = 'SOURCE'))),
by_agent AS (SELECT id FROM library WHERE id IN (SELECT id FROM readable) AND collection IN (0, 4) AND (source_id IS NULL OR source_id = 0))"""
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NEAR = f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id <> 3 ORDER BY similarity DESC, vec_id"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_KEYWORDS = rf"""kw AS (SELECT doc_id AS id, term, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{N}}-]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
top AS (SELECT id, term, n FROM kw QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, term) <= 8)"""
_FACTS = """facts AS (SELECT id, unnest([{'kind': 'IDENTIFIER', 'norm': format('inv2024{:05d}', id)}, {'kind': 'MONEY', 'norm': format('USD:{:d}', price * 100)}, {'kind': 'DATE', 'norm': day || '/' || next},
  {'kind': 'DURATION', 'norm': format('P{:d}D', id % 60 + 2)}, {'kind': 'EMAIL', 'norm': format('buyer{:d}@example.org', c)}], recursive := true) FROM
  (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next, o_custkey AS c FROM orders))"""

_PART_DATES = """k AS (SELECT p_partkey AS id, p_partkey::INT AS k, p_partkey::INT % 28 + 1 AS d, p_partkey::INT % 12 + 1 AS m, p_partkey::INT % 30 + 1995 AS y FROM part),
spans AS (
  SELECT id, unnest([
    {'lo': make_date(y, m, d), 'hi': make_date(y, m, d) + INTERVAL 1 DAY, 'confidence': 'EXACT'},
    {'lo': make_date(y + 40, m, d), 'hi': make_date(y + 40, m, d) + INTERVAL 1 DAY, 'confidence': CASE WHEN d > 12 THEN 'EXACT' ELSE 'ASSUMED' END},
    {'lo': CASE WHEN d > 12 THEN make_date(y + 80, m, d) ELSE make_date(y + 80, d, m) END, 'hi': CASE WHEN d > 12 THEN make_date(y + 80, m, d) ELSE make_date(y + 80, d, m) END + INTERVAL 1 DAY, 'confidence': CASE WHEN d > 12 THEN 'EXACT' ELSE 'ASSUMED' END},
    {'lo': make_date(y + 120, m, d), 'hi': make_date(y + 120, m, d) + INTERVAL 1 DAY, 'confidence': 'EXACT'},
    {'lo': make_date(y + 160, m, d), 'hi': make_date(y + 160, m, d) + INTERVAL 1 DAY, 'confidence': 'EXACT'},
    {'lo': make_date(y + 200, m, d), 'hi': make_date(y + 200, m, d) + INTERVAL 1 DAY, 'confidence': 'EXACT'},
    {'lo': make_date(y + 240, m, 1), 'hi': make_date(y + 240, m, 1) + INTERVAL 1 MONTH, 'confidence': 'EXACT'},
    {'lo': make_date(y + 280, k % 4 * 3 + 1, 1), 'hi': make_date(y + 280, k % 4 * 3 + 1, 1) + INTERVAL 3 MONTH, 'confidence': 'EXACT'},
    {'lo': DATE '2026-01-01' + k % 365 - 1, 'hi': (DATE '2026-01-01' + k % 365)::TIMESTAMP, 'confidence': 'ASSUMED'}], recursive := true) FROM k),
dated AS (SELECT id, strftime(lo, '%Y-%m-%d') || '/' || strftime(hi, '%Y-%m-%d') AS norm, epoch_ms(lo::TIMESTAMP) AS ts, epoch_ms(hi::TIMESTAMP) AS ts_end, confidence FROM spans)"""


def _snap(keep, shift):
    price = f"floor(o_totalprice)::BIGINT + {shift}"
    return f"(SELECT o_orderkey AS key, sha256('o_orderkey = ' || o_orderkey || chr(10) || 'o_orderstatus = ' || o_orderstatus || chr(10) || 'price = ' || ({price})) AS version FROM orders WHERE {keep})"


_MOVED = "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"
_SHAPES = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c})::BIGINT AS filled, count(DISTINCT {c}::VARCHAR)::BIGINT AS distinct_values, min(length({c}::VARCHAR))::INT AS shortest, max(length({c}::VARCHAR))::INT AS longest, round(avg(length({c}::VARCHAR)), 4) AS mean_length, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS greatest, count(*)::BIGINT AS rows FROM customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)

_TYPE_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.TYPES.items()) + "}"
_TYPES = rf"WITH e AS (SELECT page_id, lower(regexp_extract(url, '[^/]\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages) SELECT page_id, extension, coalesce({_TYPE_NAMES}[extension], 'application/octet-stream') AS content_type FROM e"

ORACLES = {
    "T1_hybrid_search": rf"""WITH {_ACCESS}, near AS ({_NEAR}), words AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM library WHERE id IN (SELECT id FROM readable)),
      occ AS (SELECT id, w, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM words) WHERE w IN ('the', 'and')),
      ends AS (SELECT *, max(CASE WHEN w = 'the' THEN i END) OVER up AS ti, max(CASE WHEN w = 'the' THEN pos END) OVER up AS tp, max(CASE WHEN w = 'and' THEN i END) OVER up AS ai, max(CASE WHEN w = 'and' THEN pos END) OVER up AS ap FROM occ WINDOW up AS (PARTITION BY id ORDER BY pos)),
      begun AS (SELECT *, least(ti, ai) AS b, least(tp, ap) AS p, lag(least(ti, ai)) OVER (PARTITION BY id ORDER BY pos) AS before FROM ends WHERE ti IS NOT NULL AND ai IS NOT NULL),
      kr AS (SELECT id, sum(0.1::DOUBLE / (1 + (pos - p) - (i - b))) AS rank FROM begun WHERE before IS NULL OR b > before GROUP BY id)
      SELECT id, round(0.5 * coalesce(rank, 0) + 0.5 * coalesce(similarity, 0), 6)::DOUBLE AS score FROM kr FULL JOIN (SELECT vec_id AS id, similarity FROM near WHERE vec_id IN (SELECT id FROM readable)) USING (id) ORDER BY score DESC, id LIMIT 10""",
    "Fm1_nearest_vectors": f"{_NEAR} LIMIT 10",
    "G6_entitled": f"WITH {_ACCESS} SELECT id FROM entitled",
    "G6_readable": f"WITH {_ACCESS} SELECT id FROM readable",
    "G6_readable_by_agent": f"WITH {_ACCESS} SELECT id FROM by_agent",
    "A16_readable_per_collection": f"WITH {_ACCESS} SELECT collection, count(*)::BIGINT AS readable FROM library WHERE id IN (SELECT id FROM readable) GROUP BY collection",
    "P8_shelf": rf"""WITH {LIBRARY_SQL}, {_KEYWORDS}, r AS (SELECT id, visibility, CASE WHEN id % 3 > 0 THEN collection::VARCHAR ELSE 'NONE' END AS shelf, 'doc ' || id || '.er' AS name, 'topic ' || id % 10 || CASE WHEN id % 8 = 0 THEN '|erst' ELSE '' END AS topics FROM library),
      k AS (SELECT id, string_agg(lower(term), '|') AS words FROM top GROUP BY id), a AS (SELECT r.*, name || '|' || topics || '|' || coalesce(words, '') AS all_ FROM r LEFT JOIN k USING (id))
      SELECT id, ' ER ' AS asked FROM a WHERE visibility = 'PUBLIC' AND shelf = 'NONE' AND contains(all_, 'er') UNION ALL SELECT id, 'erst' FROM a WHERE contains(all_, 'erst')
      UNION ALL SELECT id, 'topic 7' FROM a WHERE visibility = 'STAFF' AND shelf = '1' AND contains(all_, 'topic 7') UNION ALL SELECT id, '' FROM a WHERE visibility = 'PRIVATE' AND shelf = 'NONE'""",
    "Fs1_keywords": f"WITH {_KEYWORDS} SELECT * FROM top",
    "A23_keyword_profile": f"WITH {_KEYWORDS} SELECT term, count(DISTINCT id)::BIGINT AS documents FROM top GROUP BY term ORDER BY documents DESC, term LIMIT 12",
    "Fs2_entities": rf"""WITH t AS (SELECT doc_id AS id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents),
      e AS (SELECT id, list_concat(regexp_extract_all(text, '{T.ENTITIES[0]}'), regexp_extract_all(text, '{T.ENTITIES[1]}'),
        list_filter(regexp_extract_all(text, '{T.ENTITIES[2]}'), lambda x: lower(regexp_extract(x, '^[A-Za-z]+')) NOT IN ({_STOP})), list_transform(regexp_extract_all(text, '{T.ENTITIES[3]}', 1), lambda x: trim(x))) AS e FROM t),
      f AS (SELECT id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:16], '|') AS entities FROM e) SELECT * FROM f WHERE entities <> ''""",
    "Fs6_squeeze": r"WITH f AS (SELECT doc_id AS id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents) SELECT id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS head FROM f",
    "Fs16_content_types": _TYPES,
    "E6_furniture": r"WITH l AS (SELECT lang AS grp, doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT grp, count(DISTINCT id) AS total FROM l GROUP BY grp) SELECT grp, line, count(DISTINCT id)::BIGINT AS documents FROM l JOIN t USING (grp) WHERE length(line) BETWEEN 1 AND 120 GROUP BY grp, line, total HAVING count(DISTINCT id) >= 2 AND count(DISTINCT id) > 0.01 * total",
    "T11_char_budget": f"WITH {LIBRARY_SQL} SELECT id, collection, sum(length(text)) OVER (PARTITION BY collection ORDER BY id)::BIGINT AS upto FROM library QUALIFY upto <= 20000",
    "W3_hash_sample": "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id)::INT AS place FROM documents QUALIFY place <= 2",
    "C8_facts": f"WITH {_FACTS} SELECT id, kind, norm FROM facts",
    "J4_fact_filters": f"WITH {_FACTS} SELECT id FROM facts GROUP BY id HAVING bool_or(kind = 'DURATION' AND norm = 'P10D') AND bool_or(kind = 'EMAIL' AND norm = 'buyer7@example.org')",
    "A25_fact_rarity": f"WITH {_FACTS} SELECT kind, norm, count(DISTINCT id)::BIGINT AS documents FROM facts GROUP BY ALL HAVING count(DISTINCT id) <= 0.2 * (SELECT count(*) FROM orders)",
    "C1_dates": f"WITH {_PART_DATES} SELECT id, norm, ts, ts_end, confidence FROM dated",
    "C2_money": """WITH k AS (SELECT p_partkey AS id, p_partkey::BIGINT AS k FROM part)
      SELECT id, unit || ':' || num AS norm, num, unit, confidence FROM (SELECT id, unnest([
        {'unit': 'USD', 'num': ((k % 900 + 1) * 1000 + k % 1000) * 100 + 50, 'confidence': 'ASSUMED'}, {'unit': 'EUR', 'num': k % 90 * 100 + 25, 'confidence': 'EXACT'},
        {'unit': 'EUR', 'num': ((k % 900 + 1) * 1000 + k % 1000) * 100 + 75, 'confidence': 'EXACT'}, {'unit': 'CLP', 'num': (k % 900 + 1) * 1000 + k % 1000, 'confidence': 'EXACT'},
        {'unit': 'JPY', 'num': k % 5000, 'confidence': 'EXACT'}, {'unit': 'GBP', 'num': k % 70 * 100 + 50, 'confidence': 'EXACT'}], recursive := true) FROM k)""",
    "C3_durations": """WITH k AS (SELECT p_partkey AS id, p_partkey::BIGINT AS k FROM part)
      SELECT id, unnest([{'norm': 'P' || (k % 50 + 2) || 'D', 'num': (k % 50 + 2) * 86400}, {'norm': 'PT' || (k % 20 + 1) || 'H30M', 'num': (k % 20 + 1) * 3600 + 1800},
        {'norm': 'P' || (k % 5 + 1) || 'W2D', 'num': (k % 5 + 1) * 604800 + 172800}, {'norm': 'P' || (k % 9 + 2) || 'W', 'num': (k % 9 + 2) * 604800}, {'norm': 'PT' || k % 55 || 'M', 'num': k % 55 * 60}], recursive := true) FROM k""",
    "C7_quantities": """WITH k AS (SELECT p_partkey AS id, p_partkey::BIGINT AS k FROM part)
      SELECT id, n::VARCHAR || ':' || unit AS norm, n::DOUBLE AS num, unit FROM (SELECT id, unnest([{'n': (k % 50)::VARCHAR, 'unit': 'kg'}, {'n': (k % 16) || '.5', 'unit': 'gb'}, {'n': (k % 100)::VARCHAR, 'unit': '%'}, {'n': ((k % 70 * 10) + 5)::VARCHAR, 'unit': 'km'}], recursive := true) FROM k)""",
    "P10_fact_windows": f"""WITH {_PART_DATES}, months AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders)
      SELECT DISTINCT id, strftime(m, '%Y-%m') AS window FROM dated JOIN months ON ts < epoch_ms(m + INTERVAL 1 MONTH) AND ts_end > epoch_ms(m)""",
    "A20_column_shapes": _SHAPES,
    "A21_frequent_values": "SELECT l_returnflag AS value, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, value LIMIT 3",
    "A22_prefix_rollup": "WITH k AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p, length(html)::BIGINT AS size FROM pages) SELECT prefix, count(*)::BIGINT AS objects, sum(size)::BIGINT AS bytes FROM (SELECT unnest(list_distinct([array_to_string(p[1:i], '/') for i in range(1, greatest(len(p) - 1, 1) + 1)])) AS prefix, size FROM k) GROUP BY prefix",
    "U4_schema_drift": """WITH o AS (SELECT p_brand AS fqn, p_type AS name, ['text', 'integer', 'numeric', 'date'][max(p_size)::INT % 4 + 1] AS type FROM part WHERE p_partkey % 10 > 0 AND p_brand <> 'Brand#3' GROUP BY p_brand, p_type),
      n AS (SELECT p_brand AS fqn, p_type AS name, ['text', 'integer', 'numeric', 'date'][max(p_size + CASE WHEN p_partkey % 10 = 3 THEN 1 ELSE 0 END)::INT % 4 + 1] AS type FROM part WHERE p_partkey % 10 < 9 AND p_brand <> 'Brand#11' GROUP BY p_brand, p_type)
      SELECT fqn, NULL AS name, 'added' AS change FROM n WHERE fqn NOT IN (SELECT fqn FROM o) GROUP BY fqn UNION ALL SELECT fqn, NULL, 'removed' FROM o WHERE fqn NOT IN (SELECT fqn FROM n) GROUP BY fqn
      UNION ALL SELECT fqn, name, 'retyped' FROM o JOIN n USING (fqn, name) WHERE o.type <> n.type""",
    "Fm6_power_of_two": "SELECT o_orderkey, CASE WHEN o_custkey <= 0 THEN 0 ELSE (1::BIGINT << (length(bin(o_custkey)) - 1)::BIGINT) END::BIGINT AS bucket FROM orders",
    "Fm8_interval_overlap": "SELECT p_partkey, round(greatest(least(p_size + 10, 35) - greatest(p_size, 20), 0)::DOUBLE / (greatest(p_size + 10, 35) - least(p_size, 20)), 6) AS overlap FROM part",
    "J15_keyword_edges": f"""WITH {_KEYWORDS}, s AS (SELECT id, list_sort(list(term)) AS ks FROM top GROUP BY id), o AS (SELECT min(id) AS id, unnest(ks) AS term FROM s GROUP BY ks)
      SELECT x.id AS a, y.id AS b, count(*)::BIGINT AS common, round(count(*) / 10.0::DOUBLE, 4) AS weight FROM o x JOIN o y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2""",
    "J15_benchmark_overlap": r"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS w FROM benchmark),
      j AS (SELECT * FROM i WHERE w <> ''), n AS (SELECT item_id, count(*) AS n FROM j GROUP BY 1)
      SELECT doc_id, item_id, count(*)::BIGINT AS common, round(count(*)::DOUBLE / n, 6) AS containment FROM d JOIN j USING (w) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 2 * count(*) >= n""",
    "U5_undirected_edges": "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag AS kind, max(l_extendedprice) AS weight FROM lineitem GROUP BY ALL",
    "G3_two_hops": """WITH e0 AS (SELECT l_partkey AS a, -l_suppkey AS b, max(l_discount) AS weight FROM lineitem GROUP BY ALL),
      e AS (SELECT a, b, weight FROM (SELECT a, b, weight FROM e0 UNION ALL SELECT b, a, weight FROM e0) WHERE weight > 0 AND b % 7 <> 0),
      h1 AS (SELECT b AS id, max(weight) AS c FROM e WHERE a IN (1, 2, 3) GROUP BY b), h2 AS (SELECT e.b AS id, max(weight * c) AS c FROM e JOIN h1 ON h1.id = e.a GROUP BY e.b)
      SELECT id, round(max(g), 6)::DOUBLE AS graph FROM (SELECT id, c * 0.6::DOUBLE AS g FROM h1 UNION ALL SELECT id, c * 0.36::DOUBLE FROM h2) GROUP BY id""",
    "J20_citation_check": f"""WITH {_ACCESS}, c AS (SELECT o_orderkey // 3 AS draft, o_orderkey % (SELECT count(*) FROM documents) AS doc, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 - 1 END AS chunk FROM orders),
      r AS (SELECT draft, CASE WHEN l.gone THEN 0 WHEN l.source_id = 3 THEN 1 WHEN doc NOT IN (SELECT id FROM by_agent) THEN 2 WHEN chunk > 0 AND chunk >= ceil(coalesce(length(l.text), 0) / 400.0) THEN 3 END AS k FROM c LEFT JOIN library l ON l.id = c.doc)
      SELECT draft, ['GONE', 'SOURCE_OFF', 'DARK', 'CHUNK_GONE'][min(k) + 1] AS refusal FROM r GROUP BY draft""",
    "R2_sync_changes": f"SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'gone' WHEN o.version = n.version THEN 'unchanged' ELSE 'changed' END AS change, count(*)::BIGINT AS n FROM {_snap(OLD, 0)} o FULL JOIN {_snap(NEW, _MOVED)} n ON o.key = n.key GROUP BY 1",
    "S20_sync_upsert": f"SELECT key, version FROM {_snap(NEW, _MOVED)}",
    "R12_ticket_numbers": "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey)::BIGINT + 1000 AS number FROM customer",
}
