"""Queries of retrieval and routing, and the same rows as SQL."""

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import route as O
from ..operators import search as S
from ..tables import library, table
from .knowledge import _ACCESS, _COS, readable, words

C = F.col
TERMS = ["the", "and"]
ENTITY = "with"


def cover_rank(s, d):
    return S.keyword_rank(words(s, d), TERMS).select("id", F.round("rank", 6).alias("rank"))


def questions(s, d, n=None):
    """Benchmark items as questions: their distinct words, or the ``n`` longest of these, ties by the alphabet."""
    held = F.array_distinct(S.words_of(C("text")))
    order = F.array_sort(F.transform(held, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    terms = F.transform(order, lambda x: x["w"])
    return table(s, d, "benchmark").select(C("item_id").alias("question"), (F.slice(terms, 1, n) if n else terms).alias("terms"), "text")


def question_covers(s, d):
    """Documents by cover rank for each benchmark item's four longest words."""
    return S.ranked_covers(words(s, d), questions(s, d, 4)).select("question", "id", F.round("rank", 6).alias("rank"))


def retrieval_recall(s, d):
    """Share of benchmark items of which a document that holds the passage is found in the first place,
    and in the first three, by the item's four longest words; of items that some document holds."""
    docs, asked = words(s, d), questions(s, d)
    held = S.ranked_covers(docs, asked).select("question", "id")
    held = held.join(asked.select("question", C("text").alias("passage")), "question").join(docs, "id")
    truth = held.where(F.contains("text", "passage")).select("question", "id")
    ranked = question_covers(s, d)
    hits = ranked.join(truth, ["question", "id"]).groupBy("question").agg(F.max(F.struct("rank", (-C("id")).alias("minus"))).alias("best"))
    better = ranked.join(hits, "question").where(F.struct("rank", (-C("id")).alias("minus")) >= C("best")).groupBy("question").agg(F.count("*").alias("place"))
    return R.recall(truth.select("question").distinct().join(better, "question", "left"))


def matching_chunks(s, d):
    """Paragraphs of readable documents that hold all terms, or the entity: (doc, section, lex, vec, entity)."""
    lib = library(s, d).join(readable(s, d), "id", "left_semi")
    parts = lib.select("id", F.posexplode(F.split("text", "\n\n", -1)).alias("section", "text"))
    every, entity = (F.lit(True), F.contains(F.lower("text"), F.lit(ENTITY)))
    for t in TERMS:
        every = every & F.contains(F.lower("text"), F.lit(t))
    some = parts.where(every | entity).select("id", "section", F.explode(F.array(S.words_of(C("text")))).alias("w"))  # rows made by explode are made once, before any filter on them
    rank = S.cover_density(S.hits_of(C("w"), TERMS), len(TERMS))
    judged = F.struct(F.round(S.bounded(rank), 9).alias("lex"), F.array_contains("w", ENTITY).alias("entity"))
    found = some.select("id", "section", F.explode(F.array(judged)).alias("x")).select("id", "section", "x.lex", "x.entity").where("lex > 0 OR entity")
    vectors = table(s, d, "embeddings")
    near = S.similarities(vectors, vectors, 3).select(C("vec_id").alias("id"), C("similarity").alias("vec"))
    return found.join(near, "id", "left").select(C("id").alias("doc"), "section", "lex", "vec", "entity")


def source_edges(s, d):
    """Edges of several kinds between documents, by arithmetic on their ids."""
    i = C("doc_id")
    kinds = [("SHARED_KEYWORD", i + 1, (i % 10) / 10), ("SAME_COLLECTION", 2 * i + 3, F.lit(1.0)), ("NEAR_DUPLICATE", i + 7, F.lit(1.0)), ("DECLARED_FK", F.floor(i / 2), F.lit(0.8)), ("TEMPORAL_ALIGNMENT", i + 5, F.lit(0.25)), ("OTHER", i + 2, F.lit(1.0))]
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.cast("long").alias("b"), w.cast("double").alias("weight")) for k, b, w in kinds]))
    return table(s, d, "documents").select(i.alias("a"), made.alias("e")).select("a", "e.b", "e.kind", "e.weight")


def routed(s, d):
    members = library(s, d).where("source_id IS NOT NULL").select("id", C("source_id").alias("source"))
    return O.route(readable(s, d), matching_chunks(s, d), source_edges(s, d), members, 25)


QUERIES = {"Fm4_cover_rank": cover_rank, "Fm4_question_covers": question_covers, "A32_retrieval_recall": retrieval_recall, "G3_route": routed}

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def covers_sql(rows: str, keys: str, terms: list[str]) -> str:
    """CTEs that end in ``covered`` (keys, rank): rows is a table with keys and an array w of words."""
    known = ", ".join(f"'{t}'" for t in terms)
    last = ", ".join(f"max(CASE WHEN w = '{t}' THEN i END) OVER up AS i{k}, max(CASE WHEN w = '{t}' THEN pos END) OVER up AS p{k}" for k, t in enumerate(terms))
    every = " AND ".join(f"i{k} IS NOT NULL" for k in range(len(terms)))
    low_i, low_p = (", ".join(f"{c}{k}" for k in range(len(terms))) for c in "ip")
    return f"""occ AS (SELECT {keys}, w, pos, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i FROM (SELECT {keys}, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM {rows}) WHERE w IN ({known})),
ends AS (SELECT *, {last} FROM occ WINDOW up AS (PARTITION BY {keys} ORDER BY pos)),
begun AS (SELECT *, least({low_i}) AS b, least({low_p}) AS p, lag(least({low_i})) OVER (PARTITION BY {keys} ORDER BY pos) AS before FROM ends WHERE {every}),
covered AS (SELECT {keys}, sum(0.1::DOUBLE / (1 + (pos - p) - (i - b))) AS rank FROM begun WHERE before IS NULL OR b > before GROUP BY {keys})"""


_MANY = f"""asked AS (SELECT item_id AS question, list_distinct({WORDS_SQL}) AS every, text FROM benchmark),
four AS (SELECT question, list_sort(list_transform(every, lambda w: {{'k': -length(w), 'w': w}}))[1:4] AS best FROM asked),
wanted AS (SELECT question, unnest(list_transform(best, lambda x: x.w)) AS term, len(best) AS n FROM four),
spread AS (SELECT doc_id AS id, unnest({WORDS_SQL}) AS w, generate_subscripts({WORDS_SQL}, 1) AS pos FROM documents),
hits AS (SELECT question, n, id, term, pos, row_number() OVER (PARTITION BY question, id ORDER BY pos) AS i FROM wanted JOIN spread ON w = term),
latest AS (SELECT a.question, a.n, a.id, a.i, a.pos, b.term, max(b.i) AS nth, max(b.pos) AS place FROM hits a JOIN hits b ON a.question = b.question AND a.id = b.id AND b.i <= a.i GROUP BY ALL),
stretches AS (SELECT question, id, i, pos, min(nth) AS b, min(place) AS p FROM latest GROUP BY question, id, i, pos, n HAVING count(*) = n),
steps AS (SELECT *, lag(b) OVER (PARTITION BY question, id ORDER BY i) AS before FROM stretches),
ranked AS (SELECT question, id, round(sum(0.1::DOUBLE / (1 + (pos - p) - (i - b))), 6) AS rank FROM steps WHERE before IS NULL OR b > before GROUP BY question, id)"""

_FACTOR = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in O.FACTORS.items())
ORACLES = {
    "Fm4_cover_rank": f"WITH words AS (SELECT doc_id AS id, {WORDS_SQL} AS w FROM documents), {covers_sql('words', 'id', TERMS)} SELECT id, round(rank, 6) AS rank FROM covered",
    "Fm4_question_covers": f"WITH {_MANY} SELECT * FROM ranked",
    "A32_retrieval_recall": f"""WITH {_MANY}, truth AS (SELECT question, doc_id AS id FROM asked a JOIN documents d ON contains(d.text, a.text) WHERE len(every) > 0),
      places AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY rank DESC, id) AS place FROM ranked),
      found AS (SELECT t.question, min(place) AS place FROM truth t LEFT JOIN places p ON p.question = t.question AND p.id = t.id GROUP BY t.question)
      SELECT round(avg(coalesce(place <= 1, false)::INT), 6)::DOUBLE AS recall_1, round(avg(coalesce(place <= 3, false)::INT), 6)::DOUBLE AS recall_3 FROM found""",
    "G3_route": f"""WITH RECURSIVE {_ACCESS}, parts AS (SELECT id, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS section FROM library WHERE id IN (SELECT id FROM readable)),
      words AS (SELECT id, section, {WORDS_SQL} AS w FROM parts), {covers_sql('words', 'id, section', TERMS)},
      near AS (SELECT e.vec_id AS id, round({_COS}, 6) AS vec FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id <> 3),
      chunks AS (SELECT w.id, w.section, round(coalesce(rank, 0) / (coalesce(rank, 0) + 1), 9) AS lex, vec, list_contains(w, '{ENTITY}') AS entity FROM words w LEFT JOIN covered c ON c.id = w.id AND c.section = w.section LEFT JOIN near n ON n.id = w.id WHERE rank > 0 OR list_contains(w, '{ENTITY}')),
      scored AS (SELECT r.id, max(lex) AS lex, max(vec) AS vec, count(DISTINCT CASE WHEN lex >= 0.15 THEN section END) AS alt, bool_or(entity) AS entity_hit FROM readable r LEFT JOIN chunks c ON c.id = r.id GROUP BY r.id),
      pre AS (SELECT *, 0.5::DOUBLE * coalesce(vec, 0) + 0.5::DOUBLE * coalesce(lex, 0) + 0.05::DOUBLE * least(alt, 3) AS pre0 FROM scored),
      edges AS (SELECT doc_id AS a, unnest([{{'kind': 'SHARED_KEYWORD', 'b': doc_id + 1, 'weight': (doc_id % 10)::DOUBLE / 10}}, {{'kind': 'SAME_COLLECTION', 'b': 2 * doc_id + 3, 'weight': 1::DOUBLE}}, {{'kind': 'NEAR_DUPLICATE', 'b': doc_id + 7, 'weight': 1::DOUBLE}},
        {{'kind': 'DECLARED_FK', 'b': doc_id // 2, 'weight': 0.8::DOUBLE}}, {{'kind': 'TEMPORAL_ALIGNMENT', 'b': doc_id + 5, 'weight': 0.25::DOUBLE}}, {{'kind': 'OTHER', 'b': doc_id + 2, 'weight': 1::DOUBLE}}], recursive := true) FROM documents),
      ways AS (SELECT a, b, kind, weight FROM edges UNION ALL SELECT b, a, kind, weight FROM edges),
      dups AS (SELECT p.*, EXISTS (SELECT 1 FROM ways k JOIN pre peer ON peer.id = k.b WHERE k.kind = 'NEAR_DUPLICATE' AND k.a = p.id AND (peer.pre0 > p.pre0 OR peer.pre0 = p.pre0 AND peer.id < p.id)) AS dup FROM pre p),
      seeds AS (SELECT id FROM dups WHERE coalesce(lex, 0) > 0 OR entity_hit OR dup),
      walk(seed, id, hop, carried) AS (
        SELECT * FROM (SELECT s.id, y.id, 1, 0.30::DOUBLE FROM seeds s JOIN library x ON x.id = s.id JOIN library y ON y.source_id = x.source_id AND y.id <> s.id WHERE y.id IN (SELECT id FROM readable) UNION ALL SELECT id, id, 0, 1::DOUBLE FROM seeds)
        UNION ALL
        SELECT g.seed, k.b, g.hop + 1, g.carried * CASE WHEN k.kind = 'TEMPORAL_ALIGNMENT' THEN 1 + k.weight ELSE k.weight * CASE k.kind {_FACTOR} ELSE 0 END END
        FROM walk g JOIN ways k ON k.a = g.id JOIN readable e ON e.id = k.b WHERE g.hop < 2 AND k.weight > 0 AND k.b <> g.seed AND k.b <> g.id),
      graphs AS (SELECT id, max(carried * 0.6::DOUBLE ** hop) AS graph FROM walk WHERE hop > 0 GROUP BY id),
      final AS (SELECT d.*, coalesce(graph, 0) AS graph, pre0 + 0.20::DOUBLE * coalesce(graph, 0) AS pre FROM dups d LEFT JOIN graphs USING (id))
      SELECT id, round(pre - CASE WHEN dup THEN 0.50::DOUBLE ELSE 0 END, 6) AS score, round(pre, 6) AS pre, round(graph, 6) AS graph, coalesce(entity_hit, false) AS entity_hit, alt, dup, (SELECT count(*) FROM readable)::BIGINT AS entitled
      FROM final ORDER BY coalesce(entity_hit, false) DESC, score DESC, id LIMIT 25""",
}
