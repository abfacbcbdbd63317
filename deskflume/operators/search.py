"""Hybrid retrieval: keyword rank and vector similarity over what the reader may see."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Fixed value: what a hit weighs.
WEIGHT = 0.1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarities(vectors: DataFrame, every: DataFrame, query_id: int) -> DataFrame:
    """(vec_id, similarity) of all ``vectors`` but the query's to the query vector, one broadcast row of ``every``."""
    query = every.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    scored = vectors.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(query))
    return scored.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def nearest(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    """The ``k`` vectors most like the given one, by exact cosine."""
    return similarities(vectors, vectors, query_id).orderBy(F.desc("similarity"), "vec_id").limit(k)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and figures; a word's place is its number, from 1."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cover_density(hits: Column, terms: int) -> Column:
    """Rank of one text by covers: stretches from one hit to another that hold every term and no
    shorter such stretch. A cover counts WEIGHT over one more than the words in it that are no hits.

    hits: array of (place, term), by place, term from 1 to ``terms``. One fold: at each hit the latest
    places of all terms give the shortest stretch that ends there; it is a cover if it begins behind
    the last one's beginning. Texts without a cover rank 0."""
    none = F.array_repeat(F.lit(-1), terms)
    begin = F.struct(none.alias("places"), none.alias("numbers"), F.lit(0).alias("n"), F.lit(-1).alias("low"), F.lit(0.0).alias("rank"))

    def step(acc, x):
        def put(old, value):
            return F.transform(old, lambda v, i: F.when(i + 1 == x["term"], value).otherwise(v))

        new = F.struct(put(acc["places"], x["place"]).alias("places"), put(acc["numbers"], acc["n"]).alias("numbers"))
        first, number = F.array_min(new["places"]), F.array_min(new["numbers"])
        cover = number > acc["low"]
        noise = (x["place"] - first) - (acc["n"] - number)
        rank = acc["rank"] + F.when(cover, F.lit(WEIGHT) / (noise + 1)).otherwise(0.0)
        return F.struct(new["places"].alias("places"), new["numbers"].alias("numbers"), (acc["n"] + 1).alias("n"), F.when(cover, number).otherwise(acc["low"]).alias("low"), rank.alias("rank"))

    return F.aggregate(hits, begin, step, lambda acc: acc["rank"])


def bounded(rank: Column) -> Column:
    """A rank between 0 and 1."""
    return rank / (rank + 1)


def term_hits(text: Column, terms: list[str]) -> Column:
    """Array of (place, term) of a text's words that are terms, by place."""
    return hits_of(words_of(text), terms)


def hits_of(words: Column, terms: list[str]) -> Column:
    """``term_hits`` of a text whose words are there."""
    known = F.array(*map(F.lit, terms))
    placed = F.transform(words, lambda w, i: F.struct((i + 1).alias("place"), F.array_position(known, w).cast("int").alias("term")))
    return F.filter(placed, lambda x: x["term"] > 0)


def keyword_rank(docs: DataFrame, terms: list[str], text="text") -> DataFrame:
    """(id, rank) of texts that hold every term, by cover density. Nothing is shuffled."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    some = F.reduce(F.array(*[F.contains(F.lower(text), F.lit(t)) for t in terms]), F.lit(True), lambda a, x: a & x)
    ranked = docs.where(some).select("id", cover_density(term_hits(F.col(text), terms), len(terms)).alias("rank"))
    return ranked.where("rank > 0")


def ranked_covers(docs: DataFrame, questions: DataFrame, text="text") -> DataFrame:
    """(question, id, rank) for many questions (question, terms) at once: texts that hold every term.

    Postings (id, term, places) of the words that some question has are joined with the questions'
    terms. A question meets a text through its rarest term, so a term that most texts hold brings no pair of
    its own; the text's postings then join the pairs."""
    asked = questions.select("question", F.array_distinct("terms").alias("terms"), F.size(F.array_distinct("terms")).alias("n")).where("n > 0")
    own = asked.select("question", "n", F.posexplode("terms").alias("at", "term"))
    vocabulary = own.select("term").distinct()
    places = docs.select("id", F.posexplode(words_of(F.col(text))).alias("place", "term")).join(vocabulary, "term", "left_semi")
    postings = places.groupBy("id", "term").agg(F.sort_array(F.collect_list(F.col("place") + 1)).alias("places"))  # places of one word in one text
    spread = own.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    rarest = spread.groupBy("question").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("question", F.col("r.term").alias("term"))
    pairs = rarest.join(postings.select("id", "term"), "term").select("question", "id")
    met = pairs.join(own, "question").join(postings, ["id", "term"])
    term = F.col("at") + 1
    hits = F.transform("places", lambda p: F.struct(p.alias("place"), term.alias("term")))
    whole = met.groupBy("question", "id", "n").agg(F.count("*").alias("held"), F.sort_array(F.flatten(F.collect_list(hits))).alias("hits")).where("held = n")
    sizes = [r.n for r in asked.select("n").distinct().collect()]  # lengths of questions: a few numbers
    rank = F.coalesce(*[F.when(F.col("n") == n, cover_density(F.col("hits"), n)) for n in sorted(sizes)]) if sizes else F.lit(0.0)
    return whole.select("question", "id", rank.alias("rank"))


def blend(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Half keyword rank, half similarity; a side that is missing counts 0. Ties by id."""
    both = keyword.join(vector, "id", "full_outer")
    score = 0.5 * F.coalesce("rank", F.lit(0.0)) + 0.5 * F.coalesce("similarity", F.lit(0.0))
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def history(tickets: DataFrame, terms: list[str], k: int, window: int = 60) -> DataFrame:
    """Ticket search: the newest ``window`` rows that hold any term, scored title 3, outcome 2, body 1 for each
    term, and 2 more where something counts and the ticket is settled; ties by the time of resolution, or of creation.
    tickets: id, title, outcome, body, status, created, resolved."""

    def held(c, t):
        return F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))

    def points(c, weight):
        return [weight * held(c, t).cast("int") for t in terms]

    candidate = F.exists(F.array(*[held("title", t) | held("body", t) for t in terms]), lambda x: x)
    pool = tickets.where(candidate).orderBy(F.desc("created"), F.desc("id")).limit(window)
    score = sum(points("title", 3) + points("outcome", 2) + points("body", 1), F.lit(0))
    settled = F.when((score > 0) & F.col("status").isin("RESOLVED", "CLOSED"), 2).otherwise(0)
    recent = F.coalesce("resolved", "created")
    return pool.select("id", (score + settled).alias("score"), recent.alias("recent")).where("score > 0").orderBy(F.desc("score"), F.desc("recent"), F.desc("id")).limit(k).drop("recent")
