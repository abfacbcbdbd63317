"""Entitlement: which documents a person, or an agent on a person's behalf, may read.

Every rule is a flag on the library's rows, joined from the grants that concern the reader, so the
library is read once and the rules are applied before anything is scored. Grants are rows of (target: DOCUMENT, COLLECTION or SOURCE; target_id; subject: USER, GROUP
or AGENT; subject_id); whether they allow reading or managing does not matter here.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def human_grants(grants: DataFrame, groups: DataFrame, user: int) -> DataFrame:
    mine = groups.where(F.col("user_id") == user).select(F.col("group_id").alias("subject_id"))
    return grants.where((F.col("subject") == "USER") & (F.col("subject_id") == user)).unionByName(grants.where("subject = 'GROUP'").join(mine, "subject_id", "left_semi"))


def _marked(library: DataFrame, grants: DataFrame, names: dict[str, str]) -> DataFrame:
    """``library`` with a boolean column for each target of ``names``: whether a grant reaches the row by it."""
    keys = {"DOCUMENT": "id", "COLLECTION": "collection", "SOURCE": "source_id"}
    for target, name in names.items():
        reached = grants.where(F.col("target") == target).select(F.col("target_id").alias(keys[target])).distinct().withColumn(name, F.lit(True))
        library = library.join(reached, keys[target], "left")
    return library


def _judged(library: DataFrame, sources: DataFrame | None, grants: DataFrame, groups: DataFrame, user: int, staff: bool, agent: int | None) -> DataFrame:
    """Ids and sources with booleans may (entitled) and under (below the ceiling of the source): one pass over the library."""
    seen = ["PUBLIC", "STAFF"] if staff else ["PUBLIC"]
    rows = _marked(library.drop("text"), human_grants(grants, groups, user), {"DOCUMENT": "h_doc", "COLLECTION": "h_col", "SOURCE": "h_src"})
    may = (F.col("owner") == user) | F.col("visibility").isin(*seen) | F.col("h_doc").isNotNull() | F.col("h_col").isNotNull()
    under = ~F.col("gone") & F.col("h_src").isNotNull()
    if agent is not None:
        rows = _marked(rows, grants.where((F.col("subject") == "AGENT") & (F.col("subject_id") == agent)), {"DOCUMENT": "a_doc", "COLLECTION": "a_col", "SOURCE": "a_src"})
        may = may & (F.col("a_doc").isNotNull() | F.col("a_col").isNotNull())
        under = under & F.col("a_src").isNotNull()
    if sources is not None:
        rows = rows.join(sources.where("state IN ('DISABLED', 'PURGED')").select("source_id", F.lit(True).alias("off")), "source_id", "left")
        under = under & F.col("off").isNull()
    return rows.select("id", may.alias("may"), (F.col("source_id").isNull() | under).alias("under"))


def entitled(library: DataFrame, grants: DataFrame, groups: DataFrame, user: int, staff: bool, agent: int | None = None) -> DataFrame:
    """Ids by ownership, visibility and grants; for an agent, those that it is granted as well."""
    return _judged(library, None, grants, groups, user, staff, agent).where("may").select("id").distinct()


def readable(library: DataFrame, sources: DataFrame, grants: DataFrame, groups: DataFrame, user: int, staff: bool, agent: int | None = None) -> DataFrame:
    """Entitled ids under the ceiling of their data source: a document from a source must not be
    gone, its source not be disabled or purged, and the source granted to the person (and agent)."""
    return _judged(library, sources, grants, groups, user, staff, agent).where("may AND under").select("id")


def per_collection(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids, "id", "left_semi").groupBy("collection").agg(F.count("*").alias("readable")).where("readable > 0")


def filed(text: str = "", visibility: str = "ALL", collection: str = "ALL") -> Column:
    """Whether a search of its shelves shows a row of a library (name, keywords, topics, visibility, collection): text
    in the name, a keyword or a topic, in any case; NONE is the shelf of what has no collection."""
    needle, shown = F.lit(text.strip().lower()), F.lit(True)

    def holds(values):
        return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), needle))

    if visibility != "ALL":
        shown = shown & (F.col("visibility") == visibility)
    if collection != "ALL":
        shown = shown & (F.coalesce(F.col("collection").cast("string"), F.lit("NONE")) == collection)
    return shown & (F.contains(F.lower("name"), needle) | holds(F.col("keywords")) | holds(F.col("topics"))) if text.strip() else shown


#: What can be wrong with a draft's citations, in the order of the checks.
REFUSALS = ("GONE", "SOURCE_OFF", "DARK", "CHUNK_GONE")


def citation_check(citations: DataFrame, lib: DataFrame, sources: DataFrame, may_read: DataFrame, chunks: DataFrame) -> DataFrame:
    """(draft, refusal) of drafts with citations (draft, doc, chunk): the first check that any citation
    fails, null if all hold. A null chunk cites the whole document."""
    off = sources.where(F.col("state").isin("DISABLED", "PURGED")).select("source_id", F.lit(True).alias("off"))
    known = lib.select(F.col("id").alias("doc"), "gone", "source_id").join(off, "source_id", "left")
    rows = (
        citations.join(known, "doc", "left")
        .join(may_read.select(F.col("id").alias("doc"), F.lit(True).alias("open")), "doc", "left")
        .join(chunks.select("doc", "chunk", F.lit(True).alias("held")), ["doc", "chunk"], "left")
    )
    fails = (F.col("gone"), F.col("off"), F.col("open").isNull(), F.col("chunk").isNotNull() & F.col("held").isNull())
    rank = F.coalesce(*[F.when(bad, F.lit(k)) for k, bad in enumerate(fails)])
    worst = rows.groupBy("draft").agg(F.min(rank).alias("rank"))
    return worst.select("draft", F.get(F.array(*map(F.lit, REFUSALS)), F.col("rank")).alias("refusal"))
