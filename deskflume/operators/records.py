"""Joins, groups and rankings of desk, library and run records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(rows: DataFrame, defaults: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` whose column takes the value that ``defaults`` (key, column) has, where it has one."""
    other = defaults.select(key, F.col(column).alias("__new"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present, key, "left_anti")


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean: whether ``keys`` has their key."""
    held = keys.select(key).distinct().withColumn("__held", F.lit(True))
    return rows.join(held, key, "left").withColumn(flag, F.col("__held").isNotNull()).drop("__held")


def latest(rows: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """(key, value) of the newest row of each key, by a partial aggregate."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def of_record(comments: DataFrame, key: str, pattern: str) -> DataFrame:
    """The last text that matches the pattern, else the last one: (key, note)."""
    noted = F.max_by("text", F.when(F.col("text").rlike(pattern), F.col("turn")))
    return comments.groupBy(key).agg(F.coalesce(noted, F.max_by("text", "turn")).alias("note"))


def siblings(seeds: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """(seed, sibling): members of a seed's group, without the seed."""
    own = seeds.join(members, member).select(F.col(member).alias("seed"), group)
    return members.join(own, group).where(F.col(member) != F.col("seed")).select("seed", F.col(member).alias("sibling"))


def outranked(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """``rows`` with a flag: another row of the group has a higher score, or the same and a smaller tie.
    The best of each group decides, so no pairs are made."""
    best = rows.groupBy(group).agg(F.max_by(tie, F.struct(F.col(score), (-F.col(tie)).alias("t"))).alias("__best"))
    return rows.join(best, group).withColumn("outranked", F.col(tie) != F.col("__best")).drop("__best")


def share_of(rows: DataFrame, key: str, which: Column) -> DataFrame:
    """Distinct keys with a row that qualifies, over all distinct keys; null without any."""
    by_key = rows.groupBy(key).agg(F.bool_or(which).alias("q"))
    n = F.count("*")
    return by_key.agg(F.when(n > 0, F.round(F.count_if("q") / n, 6)).alias("share"))


def route_scores(chunks: DataFrame, floor: float = 0.15) -> DataFrame:
    """Of each document: best rank, best similarity, sections above the floor, whether an entity was hit."""
    return chunks.groupBy("doc").agg(
        F.max("rank").alias("best_rank"), F.max("vec").alias("best_vec"), F.count_distinct(F.when(F.col("rank") >= floor, F.col("section"))).alias("sections"), F.bool_or("entity").alias("entity_hit")
    )


def routed(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` (at most 25) documents: entity hits first, then by score, then by id; with the number of all."""
    score = F.round(0.5 * F.col("best_rank") + 0.5 * F.col("best_vec") + F.least(F.col("sections"), F.lit(3)) * 0.05, 6)
    total = scores.agg(F.count("*").alias("total"))
    ranked = scores.select("doc", "entity_hit", score.alias("score")).orderBy(F.desc_nulls_last("entity_hit"), F.desc("score"), "doc").limit(min(k, 25))
    return ranked.join(F.broadcast(total))  # one row


def recall(ranked: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of questions whose truth stands among the first k: ranked has question, place (null if absent)."""
    return ranked.agg(*[F.round(F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in ks])


def first_covering(rows: DataFrame, categories: str, order: Column, name: str) -> DataFrame:
    """(category, name): the first row, by order, whose list has the category."""
    return rows.select(F.explode(categories).alias("category"), order.alias("__o"), name).groupBy("category").agg(F.min_by(name, "__o").alias(name))


def newest_kept(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """A rolling log: the newest ``n`` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def best_guess(guesses: DataFrame, key: str) -> DataFrame:
    """(key, kind, confidence): the most confident guess of each key, ties by name."""
    return guesses.groupBy(key).agg(F.min_by(F.struct("kind", "confidence"), F.struct(-F.col("confidence"), "kind")).alias("b")).select(key, "b.kind", "b.confidence")


def open_circuits(calls: DataFrame, key: str, failed: Column, ts: str, order: list[str], failures: int = 3, minutes: int = 10) -> DataFrame:
    """(key, opened_at, until): each time that ``failures`` calls in a row have failed. A success sets the count back
    and closes at once; else the circuit stays closed to calls for ``minutes``. Further failures open nothing."""
    rows = calls.select(key, F.col(ts).alias("__at"), failed.alias("__failed"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    upto = Window.partitionBy(key).orderBy(*[f"__o{i}" for i in range(len(order))])
    rows = rows.withColumn("__run", F.count_if(~F.col("__failed")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__next", F.min(F.when(~F.col("__failed"), F.col("__at"))).over(upto.rowsBetween(1, Window.unboundedFollowing)))
    nth = F.count_if("__failed").over(Window.partitionBy(key, "__run").orderBy(*[f"__o{i}" for i in range(len(order))]))
    opened = rows.withColumn("__nth", nth).where(F.col("__failed") & (F.col("__nth") == failures))
    until = F.least(F.col("__at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0)), F.col("__next"))
    return opened.select(key, F.col("__at").alias("opened_at"), until.alias("until"))


def rolled_up(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the heaviest kind of each pair; pairs linked by time alone weigh 0."""
    return edges.groupBy("a", "b").agg(F.coalesce(F.max(F.when(F.col("kind") != "TEMPORAL", F.col("weight"))), F.lit(0.0)).alias("weight"))


def purged(rows: DataFrame, key: str, expired: Column, cited: DataFrame) -> DataFrame:
    """(key, action) of expired rows: tombstone for those that something cites, else purge."""
    return flagged(rows.where(expired), cited, key, "cited").select(key, F.when(F.col("cited"), "tombstone").otherwise("purge").alias("action"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` but for the keys that ``new`` has, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sheet_chunks(rows: DataFrame, sheet: str, row: str, text: str, columns: int) -> DataFrame:
    """Windows of rows, min(30, 200 / (columns + 1)) each: (sheet, window, first_row, last_row, lines)."""
    size = min(30, 200 // (columns + 1))
    held = rows.withColumn("window", F.floor(F.col(row) / size).cast("long"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(row, text))), lambda x: x[text])  # at most 30
    return held.groupBy(sheet, "window").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.array_join(lines, "\n").alias("lines"))


def objects_below(objects: DataFrame, key="key", size="size") -> DataFrame:
    """Of each folder above the keys: objects and bytes below it, and how many there are of each extension."""
    parts = F.split(key, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ext = F.lower(F.regexp_extract(F.element_at(parts, -1), r".\.([A-Za-z0-9]+)$", 1))
    per = objects.select(F.explode(F.array_distinct(above)).alias("prefix"), ext.alias("ext"), F.col(size).alias("size")).groupBy("prefix", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    histogram = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "n"))), lambda x: F.concat(x["ext"], F.lit("="), x["n"])), ",")
    return per.groupBy("prefix").agg(F.sum("n").alias("objects"), F.sum("bytes").alias("bytes"), histogram.alias("extensions"))


def group_hash(rows: DataFrame, key: str, line: Column) -> DataFrame:
    """(key, hash): SHA-256 of a group's lines, sorted; for groups that fit a row, as the tools of a server do."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))


def scan_counters(tickets: DataFrame, at: Column) -> DataFrame:
    """One row: open tickets looked at, those past a due time, and those of them that a higher level gets."""
    late = (F.col("resolution_due") < at) | (F.col("first_response").isNull() & (F.col("response_due") < at))
    rows = tickets.where("status <> 'RESOLVED'").select("priority", late.alias("late"))
    return rows.agg(F.count("*").alias("scanned"), F.count_if("late").alias("breached"), F.count_if(F.col("late") & (F.col("priority") != "LOW")).alias("escalated"))


def whole(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, if there are any and no more than ``most``; else an error, as an empty or cut crawl would delete what it lacks."""
    n = rows.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError("the crawl found nothing" if n == 0 else f"the crawl found more than {most} rows")
    return rows
