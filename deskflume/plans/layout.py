"""Queries of chunks by layout, and the same rows as SQL."""

from pyspark.sql import functions as F

from ..functions import layout as L
from ..tables import table
from .knowledge import words

C = F.col


def page_parts(s, d):
    """Each document as one page."""
    return words(s, d).select("id", F.posexplode(L.page_parts(C("text"), 2000)).alias("part", "text")).select("id", "part", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


def items(s, d):
    """Documents' lines as items, twenty a page; a line whose length is a multiple of four is a heading."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((F.length(x) % 4 == 0).alias("heading"), x.alias("text"), F.floor(i / 20 + 1).alias("page")))
    return words(s, d).select("id", lines.alias("items"))


def headings(s, d):
    return items(s, d).select("id", F.posexplode(L.heading_chunks(C("items"))).alias("place", "c")).select("id", "place", "c.page", "c.prefix_end", F.sha2("c.text", 256).alias("sha"))


def order_tables(s, d):
    """Nations as tables of their customers, in pieces of 60 cells; the head row names the columns."""
    cells = F.array(C("c_custkey").cast("string"), C("c_mktsegment"), F.coalesce(F.nullif(C("c_name"), F.lit("Customer#000000003")), F.lit("")))
    rows = table(s, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", cells.alias("cells")))).alias("rows"))
    whole = F.concat(F.array(F.array(*map(F.lit, ("key", "segment", "name")))), C("rows.cells"))
    return rows.select("c_nationkey", F.posexplode(L.table_pieces(whole, 60)).alias("piece", "text")).select("c_nationkey", "piece", F.sha2("text", 256).alias("sha"))


QUERIES = {"E2_page_parts": page_parts, "E7_heading_paths": headings, "E7_table_pieces": order_tables}

_SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ORACLES = {
    "E2_page_parts": rf"""WITH t AS (SELECT doc_id AS id, regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM documents),
      p AS (SELECT id, t, list_transform(regexp_split_to_array(t, '\n[{_SPACE}]*\n'), lambda x: {{'b': x, 'p': []::VARCHAR[]}}) AS l FROM t WHERE t <> ''),
      j AS (SELECT id, t, list_reduce([{{'b': '', 'p': []::VARCHAR[]}}] || l, lambda a, b: CASE WHEN a.b <> '' AND length(a.b) + 2 + length(b.b) > 2000
          THEN {{'b': substr(b.b, (greatest(length(b.b) - 1, 0) // 2000) * 2000 + 1), 'p': a.p || [a.b] || [substr(b.b, k * 2000 + 1, 2000) for k in range(greatest(length(b.b) - 1, 0) // 2000)]}}
          ELSE {{'b': substr(CASE WHEN a.b = '' THEN b.b ELSE a.b || chr(10) || chr(10) || b.b END, CASE WHEN a.b = '' THEN (greatest(length(b.b) - 1, 0) // 2000) * 2000 + 1 ELSE 1 END),
                 'p': a.p || CASE WHEN a.b = '' THEN [substr(b.b, k * 2000 + 1, 2000) for k in range(greatest(length(b.b) - 1, 0) // 2000)] ELSE [] END}} END) AS s FROM p),
      x AS (SELECT id, CASE WHEN length(t) <= 2000 THEN [t] ELSE s.p || CASE WHEN s.b <> '' THEN [s.b] ELSE [] END END AS parts FROM j)
      SELECT id, (unnest(range(len(parts))))::INT AS part, length(unnest(parts))::BIGINT AS n, sha256(unnest(parts)) AS sha FROM x""",
    "E7_table_pieces": """WITH r AS (SELECT c_nationkey, '| ' || c_custkey || ' | ' || c_mktsegment || ' | ' || CASE WHEN c_name = 'Customer#000000003' THEN '' ELSE c_name END || ' |' AS line, c_custkey, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 19)::INT AS piece FROM customer)
      SELECT c_nationkey, piece, sha256('| key | segment | name |' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey)) AS sha FROM r GROUP BY ALL""",
}
