"""Desk analytics: KPIs over tickets, service levels, usage, run traces."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import eligible, next_level, rank_of

from ..tables import CATEGORIES, PRIORITIES, minutes_between

OPEN = ("OPEN", "PENDING")


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def domain_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(column, n) for every value of a fixed domain, zero where no row has it."""
    every = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def open_by_priority(tickets: DataFrame) -> DataFrame:
    return domain_counts(tickets.where(F.col("status").isin(*OPEN)), "priority", PRIORITIES)


def open_by_category(tickets: DataFrame) -> DataFrame:
    return domain_counts(tickets.where(F.col("status").isin(*OPEN)), "category", CATEGORIES)


def queue(tickets: DataFrame, needle: str, status="OPEN_ALL", category: str | None = None) -> DataFrame:
    """Ticket queue: open ones or one status, an optional category, a literal case-insensitive substring."""
    out = tickets.where(F.col("status").isin(*OPEN) if status == "OPEN_ALL" else F.col("status") == status)
    if category:
        out = out.where(F.col("category") == category)
    return out.where(F.lower("title").contains(needle.lower()))


def top_requesters(tickets: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """Most frequent requesters by display name; ties by name."""
    per = tickets.groupBy("requester").agg(F.count("*").alias("n")).join(names, "requester")
    return per.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def within(ts: str, today: Column, days: int) -> Column:
    """Whether a time lies on one of the last ``days`` days: a range on the bare column, which scans can skip by."""
    first, behind = (F.date_add(today, n).cast("timestamp_ntz") for n in (1 - days, 1))
    return (F.col(ts) >= first) & (F.col(ts) < behind)


def window_kpis(tickets: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row for the current and one for the previous window of ``days``: created, responded,
    mean minutes to the first response, resolved, mean hours to the resolution, share resolved by AI."""
    today = F.to_date(now)

    def tag(ts):
        age = F.date_diff(today, F.to_date(ts))
        return F.when(age.between(0, days - 1), "current").when(age.between(days, 2 * days - 1), "previous")

    made = tickets.where(within("created", today, 2 * days)).withColumn("period", tag(F.col("created"))).where("period IS NOT NULL").groupBy("period")
    made = made.agg(F.count("*").alias("created"), F.count("first_response").alias("responded"), half_up(F.avg(minutes_between(F.col("first_response"), F.col("created")))).alias("response_min"))
    done = tickets.where(within("resolved", today, 2 * days)).withColumn("period", tag(F.col("resolved"))).where("period IS NOT NULL").groupBy("period")
    hours = F.avg(minutes_between(F.col("resolved"), F.col("created")) / 60)
    done = done.agg(F.count("*").alias("resolved"), (half_up(hours * 10) / 10).alias("resolution_h"), F.round(F.avg(F.col("by_ai").cast("int")), 6).alias("ai_rate"))
    periods = tickets.sparkSession.createDataFrame([("current",), ("previous",)], "period string")
    zero = F.lit(0)
    return periods.join(made, "period", "left").join(done, "period", "left").select(
        "period", F.coalesce("created", zero).alias("created"), F.coalesce("responded", zero).alias("responded"), "response_min",
        F.coalesce("resolved", zero).alias("resolved"), "resolution_h", F.coalesce("ai_rate", F.lit(0.0)).alias("ai_rate"),
    )


def kpi_delta(kpis: DataFrame, column: str) -> DataFrame:
    """Change from the previous to the current window: percent, or the absolute change where it was 0."""
    sides = kpis.agg(*[F.max(F.when(F.col("period") == p, F.col(column))).alias(p) for p in ("current", "previous")])
    change = F.when(F.col("previous") == 0, F.col("current")).otherwise(half_up(100 * (F.col("current") - F.col("previous")) / F.col("previous")))
    return sides.select("current", "previous", change.cast("double").alias("delta"))


def daily_series(tickets: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Created and resolved (by AI, by people) on each of the last ``days`` days, zero-filled."""
    spark, today = tickets.sparkSession, F.to_date(now)
    span = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    made = tickets.where(within("created", today, days)).groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("created"))
    done = tickets.where(within("resolved", today, days)).groupBy(F.to_date("resolved").alias("day")).agg(F.count_if("by_ai").alias("by_ai"), F.count_if(~F.col("by_ai")).alias("by_people"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "by_ai", "by_people")]
    return F.broadcast(span).join(made, "day", "left").join(done, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), *counts)


def sla_state(tickets: DataFrame, now: Column) -> DataFrame:
    """``tickets`` with ``sla``: none, met, breached, at_risk or ok. An open ticket is on the response
    clock until its first reply, then on the resolution clock; a fifth of the window left is a risk."""
    open_ = F.col("status").isin(*OPEN)
    due = F.when(F.col("first_response").isNull() & F.col("response_due").isNotNull(), F.col("response_due")).otherwise(F.col("resolution_due"))
    left, whole = minutes_between(due, now), minutes_between(due, F.col("created"))
    live = F.when(due.isNull(), "none").when(now > due, "breached").when((whole > 0) & (left / whole <= 0.2), "at_risk").otherwise("ok")
    closed = F.when(F.col("resolved").isNull() | F.col("resolution_due").isNull(), "none").when(F.col("resolved") <= F.col("resolution_due"), "met").otherwise("breached")
    return tickets.withColumn("sla", F.when(open_, live).otherwise(closed))


def sla_counts(tickets: DataFrame, now: Column) -> DataFrame:
    return sla_state(tickets, now).groupBy("priority", "sla").agg(F.count("*").alias("n"))


def breach_scan(tickets: DataFrame, now: Column, policies: DataFrame) -> DataFrame:
    """``tickets`` with breached and to: open ones that no scan has escalated yet, whether their live due time
    is over, and the level above that they go to where the policy (priority, escalates) of their priority wants it
    and a group has them; null above the highest. ``escalated`` writes it down."""
    due = F.when(F.col("first_response").isNull(), F.col("response_due")).otherwise(F.col("resolution_due"))
    rows = tickets.where(F.col("status").isin(*OPEN) & F.col("escalated_at").isNull()).join(F.broadcast(policies), "priority", "left")
    late = F.coalesce(now > due, F.lit(False))
    return rows.withColumn("breached", late).withColumn("to", F.when(late & F.coalesce("escalates", F.lit(False)) & F.col("group").isNotNull(), next_level(F.col("level")))).drop("escalates")


def scan_counts(scanned: DataFrame) -> DataFrame:
    """One row for each priority: rows scanned, breached, escalated."""
    return scanned.groupBy("priority").agg(F.count("*").alias("scanned"), F.count_if("breached").alias("breached"), F.count("to").alias("escalated"))


def escalated(tickets: DataFrame, now: Column, policies: DataFrame) -> DataFrame:
    """``tickets`` after a scan: a second scan finds none of them again."""
    moved = breach_scan(tickets, now, policies).where("to IS NOT NULL").select("id", "to")
    rows = tickets.join(moved, "id", "left")
    done = F.col("to").isNotNull()
    return rows.withColumns({"level": F.coalesce("to", "level"), "escalated_at": F.when(done, now).otherwise(F.col("escalated_at"))}).select(*tickets.columns)


def deliverable(drafts: DataFrame, opted: list[str], failed: DataFrame, sent: DataFrame, now: Column, cap: int = 20) -> DataFrame:
    """(id, place) of drafts that go out by themselves, in their order, while the cap of a day allows: ticket not
    closed, category opted in, cited, every citation still good (refusal null), no failed check.

    drafts: id, status, category, cited, refusal; failed: id; sent: decided_at of those sent so before."""
    recent = sent.where(F.col("decided_at") >= now - F.expr("INTERVAL 24 HOURS")).agg(F.count("*").alias("sent"))
    good = drafts.where((F.col("status") != "CLOSED") & F.col("category").isin(*opted) & F.col("cited") & F.col("refusal").isNull()).join(failed, "id", "left_anti")
    first = good.select("id").orderBy("id").limit(cap)  # no more can go out
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("id")))
    return placed.join(F.broadcast(recent)).where(F.col("place") + F.col("sent") <= cap).select("id", "place")


def usage(events: DataFrame, until: Column, keys: list[str], days: int = 7) -> DataFrame:
    """Calls, tokens and mean latency of each group over the trailing days."""
    recent = events.where((F.col("ts") <= until) & (F.col("ts") > until - F.expr(f"INTERVAL {days} DAYS")))
    return recent.groupBy(*keys).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"), half_up(F.avg("value")).alias("latency"))


def pivot_counts(rows: DataFrame, key: str, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of ``column`` side by side."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])


def step_gaps(steps: DataFrame, run: str, order: list[str], ts: str, begun: str | None = None) -> DataFrame:
    """Seconds since the step before, for the first one since the run began (a column; 0 without it), never negative."""
    before = F.lag(ts).over(Window.partitionBy(run).orderBy(*order))
    gap = F.greatest(F.lit(0.0), minutes_between(F.col(ts), F.coalesce(before, F.col(begun or ts))) * 60)
    return steps.withColumn("gap", F.round(gap, 3))


def tool_trail(steps: DataFrame, run: str, tool: str, order: str) -> DataFrame:
    """Calls of each tool in a run, with the place of its first call."""
    return steps.groupBy(run, tool).agg(F.count("*").alias("calls"), F.min(order).alias("first_at"))


def last_status(steps: DataFrame, run: str, status: str, order: str) -> DataFrame:
    return steps.groupBy(run).agg(F.max_by(status, order).alias("status"), F.count("*").alias("steps"))


def newest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def page(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows and whether there are more."""
    head = rows.orderBy(*order).limit(n + 1)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))  # n + 1 rows
    return head.withColumn("place", place).withColumn("truncated", F.max(F.col("place") > n).over(Window.partitionBy(F.lit(1)))).where(F.col("place") <= n).drop("place")


def least_loaded(members: DataFrame, loads: DataFrame, group: str) -> DataFrame:
    """For each group the member with the fewest open tickets; ties by rank, then id."""
    loaded = members.join(loads, "member", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    return loaded.groupBy(group).agg(F.min(F.struct("load", "rank", "member")).alias("best")).select(group, "best.member", "best.load")


def assignees(wanted: DataFrame, members: DataFrame, loads: DataFrame) -> DataFrame:
    """(group, level, member, load) for each wanted (group, level): the person with the fewest open tickets of
    those whose tier may take the level; ties by tier, people outside the ladder last, then by id. Groups without
    one have null. members: group, member, tier, role."""
    rank = F.when(F.col("tier") == "STANDALONE", F.lit(1 << 30)).otherwise(rank_of(F.col("tier")))
    loaded = members.where("role <> 'AI_AGENT'").join(loads, "member", "left").select("group", "tier", F.struct(F.coalesce("load", F.lit(0)).alias("load"), rank.alias("rank"), "member").alias("who"))
    able = wanted.join(loaded, "group").where(eligible(F.col("tier"), F.col("level")))
    best = able.groupBy("group", "level").agg(F.min("who").alias("who"))
    return wanted.join(best, ["group", "level"], "left").select("group", "level", "who.member", "who.load")


def coverage(profiles: DataFrame, categories: str, domain: list[str]) -> DataFrame:
    """Share of the domain that the profiles' category lists cover; an empty list covers all."""
    every = F.array(*map(F.lit, domain))
    own = profiles.select(F.explode(F.when(F.size(categories) == 0, every).otherwise(F.col(categories))).alias("c")).where(F.col("c").isin(*domain))
    return own.agg(F.round(F.count_distinct("c") / len(domain), 6).alias("coverage"))
