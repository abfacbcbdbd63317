"""Upkeep of a catalogue: presence over crawls, what is due, budgets of a run, retention with all that hangs on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until values are sampled again.
RESAMPLE_DAYS = 30
#: Caps of one run, in the order in which they are tested.
CAPS = {"WALL_CLOCK": ("millis", 120_000), "ROWS": ("rows", 50_000), "BYTES": ("bytes", 100 << 20)}


def presence_spans(listings: DataFrame, crawls: DataFrame) -> DataFrame:
    """(name, state, first, last): how long each name was OK, UNREADABLE (listed, not readable) or DROPPED
    (not listed any more), as numbers of crawls.

    listings: crawl, name, readable; crawls: crawl. Crawls are numbered in their order. Only listed rows
    are looked at: what lies between two of them, or behind the last, was dropped; a name begins
    with its first listing."""
    numbered = crawls.distinct().withColumn("at", F.row_number().over(Window.orderBy("crawl")))  # one row a crawl
    end = numbered.agg(F.max("at").alias("end"))
    rows = listings.groupBy("name", "crawl").agg(F.bool_or("readable").alias("readable")).join(F.broadcast(numbered), "crawl")
    rows = rows.withColumn("state", F.when(F.col("readable"), "OK").otherwise("UNREADABLE"))
    by = Window.partitionBy("name").orderBy("at")
    rows = rows.withColumns({"before": F.lag("at").over(by), "was": F.lag("state").over(by), "after": F.lead("at").over(by)})
    begins = F.col("before").isNull() | (F.col("before") < F.col("at") - 1) | (F.col("was") != F.col("state"))
    rows = rows.withColumn("span", F.count_if(begins).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seen = rows.groupBy("name", "state", "span").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("span")
    holes = rows.join(F.broadcast(end)).select("name", F.lit("DROPPED").alias("state"), (F.col("at") + 1).alias("first"), (F.coalesce("after", F.col("end") + 1) - 1).alias("last"))
    return seen.unionByName(holes.where("first <= last"))


def present_state(spans: DataFrame) -> DataFrame:
    """(name, state, since) after the last crawl, from ``presence_spans``."""
    return spans.groupBy("name").agg(F.max_by(F.struct("state", F.col("first").alias("since")), "last").alias("s")).select("name", "s.*")


def weighed(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``edges`` (a, b, weight) with shown: 0 while an end is not OK; the weight stays for its return."""
    bad = states.where("state <> 'OK'").select("name", F.lit(True).alias("bad"))
    rows = edges
    for end in "ab":
        rows = rows.join(bad.withColumnsRenamed({"name": end, "bad": f"bad_{end}"}), end, "left")
    return rows.withColumn("shown", F.when(F.coalesce("bad_a", "bad_b").isNull(), F.col("weight")).otherwise(0.0)).drop("bad_a", "bad_b")


def tier2_due(cursor_left: Column, fingerprint: Column, fresh: Column, state: Column, days: Column, values: Column) -> Column:
    """Whether values are to be sampled: what a run left over and what has changed first, unreadable
    ones never, else when old or not complete."""
    return F.when(cursor_left | (fingerprint != fresh), True).when(state == "UNREADABLE", False).otherwise((days >= RESAMPLE_DAYS) | (values != "COMPLETE"))


def admitted(candidates: DataFrame, caps: dict[str, tuple[str, int]] = CAPS, prefix: int = 2) -> DataFrame:
    """(name, place, stopped): candidates in their order of admission until a budget is over; stopped names the
    first budget that is over before a candidate, null for admitted ones.

    candidates: name, pages, values (null or ABSENT: never sampled), and a column for each cap. The order is pages, never
    sampled first, name. What stands before a candidate is what smaller groups (pages, sampled, the
    first characters of the name) hold, summed over one row a group, and the rows before it in its own group, so
    no window holds all rows."""
    sampled = ~F.coalesce(F.col("values"), F.lit("ABSENT")).isin("ABSENT")
    rows = candidates.withColumns({"sampled": sampled, "head": F.left("name", F.lit(prefix))})
    group = ["pages", "sampled", "head"]
    sums = {"place": F.lit(1), **{c: F.col(c) for c, _ in caps.values()}}
    totals = rows.groupBy(*group).agg(*[F.sum(v).alias(f"t_{c}") for c, v in sums.items()])
    earlier = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    starts = totals.select(*group, *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"s_{c}") for c in sums])
    own = Window.partitionBy(*group).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"o_{c}": F.coalesce(F.sum(v).over(own), F.lit(0)) for c, v in sums.items()}).join(starts, group)
    over = F.coalesce(*[F.when(F.col(f"s_{c}") + F.col(f"o_{c}") > most, name) for name, (c, most) in caps.items()])
    return placed.select("name", (F.col("s_place") + F.col("o_place") + 1).alias("place"), over.alias("stopped"))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], roots: dict[str, Column], guards: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``tables`` with a column fate: gone, tombstone or null.

    links: (child table, its column, parent table, that one's column), parents before children. Rows of
    ``roots`` go, and all rows whose parent goes, level by level in semi-joins. A row that a guard (its table's
    column of the same name) holds becomes a tombstone: it stays, what hangs on it goes."""
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        falls = [roots[name]] if name in roots else []
        rows = df
        for k, (child, column, parent, other) in enumerate(links):
            if child == name:
                lost = out[parent].where("fate IS NOT NULL").select(F.col(other).alias(column), F.lit(True).alias(f"__p{k}")).distinct()
                rows = rows.join(lost, column, "left")
                falls.append(F.col(f"__p{k}").isNotNull())
        doomed = reduce(Column.__or__, falls, F.lit(False))
        guard = (guards or {}).get(name)
        if guard is not None:
            (key,) = guard.columns
            rows = rows.join(guard.distinct().withColumn("__kept", F.lit(True)), key, "left")
            fate = F.when(doomed, F.when(F.col("__kept").isNotNull(), "tombstone").otherwise("gone"))
        else:
            fate = F.when(doomed, "gone")
        out[name] = rows.withColumn("fate", fate).select(*df.columns, "fate")
    return out
