"""Desk queries: orders as tickets, events as usage and run steps, conversations as ticket history."""

from pyspark.sql import functions as F

from ..operators import desk as D
from ..operators import search as S
from ..tables import CATEGORIES, NOW, PRIORITIES, TICKETS_SQL, now, table, tickets

UNTIL = "2024-01-20 00:00:00"
TS = f"TIMESTAMP '{NOW}'"
STATUSES = ["OPEN", "PENDING", "RESOLVED"]


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def usage(spark, sf):
    rows = events(spark, sf).withColumn("team", F.col("user_id") % 5)
    return D.usage(rows, F.lit(UNTIL).cast("timestamp_ntz"), ["event_type", "team"])


def queue(spark, sf):
    named = tickets(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("requester"), F.col("c_name").alias("title")), "requester")
    return D.queue(named, "R#00000001", category="ACCESS").select("id", "status", "title")


def top_requesters(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("requester"), F.col("c_name").alias("name"))
    return D.top_requesters(tickets(spark, sf), names, 5)


def gaps(spark, sf):
    steps = events(spark, sf).withColumn("begun", F.lit("2024-01-01 00:05:00").cast("timestamp_ntz"))
    return D.step_gaps(steps, "user_id", ["ts", "event_id"], "ts", "begun").select("event_id", "user_id", "gap")


def desk_tickets(spark, sf):
    """Tickets with level, group and the time of an earlier escalation, by arithmetic."""
    k = F.col("id")
    level = F.get(F.array(*map(F.lit, ("JUNIOR", "MID", "SENIOR"))), (k / 4 % 3).cast("int"))
    return tickets(spark, sf).withColumns({"level": level, "group": F.when(k % 7 > 0, k % 7), "escalated_at": F.when(k % 9 == 0, F.col("created"))})


def policies(spark, sf):
    """Which priorities escalate: the odd ones of the orders' own."""
    level = F.get(F.array(*map(F.lit, ["URGENT", "HIGH", "MEDIUM", "MEDIUM", "LOW"])), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, sf, "orders").select(level.alias("priority")).distinct().select("priority", F.col("priority").isin("URGENT", "HIGH", "MEDIUM").alias("escalates"))


def assigned(spark, sf):
    """Suppliers as members of nations' groups, one tier in four outside the ladder, agents among them."""
    k = F.col("s_suppkey")
    tiers = F.array(*map(F.lit, ("JUNIOR", "MID", "SENIOR", "STANDALONE")))
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("group"), k.alias("member"), F.get(tiers, (k % 4).cast("int")).alias("tier"), F.when(k % 6 == 0, "AI_AGENT").otherwise("AGENT").alias("role"))
    loads = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("member")).agg((F.count("*") % 5).alias("load"))
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group"), F.explode(F.slice(tiers, 1, 3)).alias("level"))
    return D.assignees(wanted, members, loads)


def escalations(spark, sf):
    found = D.breach_scan(desk_tickets(spark, sf), now(), policies(spark, sf))
    return found.where("to IS NOT NULL").select("id", F.col("level").alias("from_level"), F.col("to").alias("to_level"))


def rescan(spark, sf):
    """Counts of a scan that follows another at once."""
    return D.scan_counts(D.breach_scan(D.escalated(desk_tickets(spark, sf), now(), policies(spark, sf)), now(), policies(spark, sf)))


def delivery(spark, sf):
    k = F.col("o_orderkey")
    items = table(spark, sf, "lineitem")
    cited = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("cited"), F.max(F.when(F.col("l_tax") > 0.07, "GONE")).alias("refusal"))
    drafts = tickets(spark, sf).select("id", "category", F.when(F.col("id") % 5 == 0, "CLOSED").otherwise(F.col("status")).alias("status")).join(cited, "id")
    failed = items.where("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_orderkey").alias("id")).distinct()
    sent = table(spark, sf, "orders").where((k % 41 == 0) & (F.col("o_orderdate") <= now())).select(F.col("o_orderdate").cast("timestamp_ntz").alias("decided_at"))
    return D.deliverable(drafts, ["ACCESS", "EMAIL"], failed, sent, now(), 60)


def newest_per_user(spark, sf):
    return D.newest(events(spark, sf), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "place")


def loads(spark, sf):
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("member"), (F.col("s_suppkey") % 3).alias("rank"))
    work = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("member")).agg(F.count("*").alias("load"))
    return D.least_loaded(members, work, "grp")


def coverage(spark, sf):
    cats = F.array(*map(F.lit, CATEGORIES))
    rows = table(spark, sf, "nation").select(F.slice(cats, F.col("n_nationkey") % 3 + 1, 2).alias("categories"))
    return D.coverage(rows, "categories", CATEGORIES)


def history(spark, sf):
    turns = table(spark, sf, "conversations")
    who = turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("body"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("outcome"),
    )
    k, day = F.col("id"), F.lit("2024-01-01").cast("date")
    status = F.get(F.array(*map(F.lit, ("OPEN", "RESOLVED", "CLOSED"))), (k % 3).cast("int"))
    rows = who.withColumns({"title": F.substring("body", 1, 40), "status": status, "created": F.date_add(day, (k * 7 % 365).cast("int")), "resolved": F.when(k % 3 > 0, F.date_add(day, (k * 11 % 500).cast("int")))})
    return S.history(rows, ["the", "ation", "erea"], 20)


QUERIES = {
    "A8_open_by_priority": lambda s, d: D.open_by_priority(tickets(s, d)),
    "A8_open_by_category": lambda s, d: D.open_by_category(tickets(s, d)),
    "P1_ticket_queue": queue,
    "A9_top_requesters": top_requesters,
    "A5_window_kpis": lambda s, d: D.window_kpis(tickets(s, d), now()),
    "Fd7_kpi_delta": lambda s, d: D.kpi_delta(D.window_kpis(tickets(s, d), now()), "created"),
    "A7_daily_series": lambda s, d: D.daily_series(tickets(s, d), now()),
    "A13_sla_states": lambda s, d: D.sla_counts(tickets(s, d), now()),
    "R7_breach_scan": escalations,
    "A29_scans": lambda s, d: D.scan_counts(D.breach_scan(desk_tickets(s, d), now(), policies(s, d))),
    "R7_scanned_again": rescan,
    "P19_auto_delivery": delivery,
    "A1_usage_rollup": usage,
    "A6_status_pivot": lambda s, d: D.pivot_counts(tickets(s, d), "priority", "status", STATUSES),
    "W2_step_gaps": gaps,
    "A28_tool_trail": lambda s, d: D.tool_trail(events(s, d), "user_id", "event_type", "event_id"),
    "R15_last_status": lambda s, d: D.last_status(events(s, d), "user_id", "event_type", "event_id"),
    "W8_newest_per_user": newest_per_user,
    "T6_page_with_flag": lambda s, d: D.page(tickets(s, d).select("id", "priority"), ["id"], 50),
    "W6_least_loaded": loads,
    "W6_assignees": assigned,
    "A12_coverage": coverage,
    "T4_ticket_history": history,
}

_COUNTS = "SELECT v AS {c}, count(t.id)::BIGINT AS n FROM (SELECT unnest({d!r}) AS v) LEFT JOIN tickets t ON t.{c} = v AND t.status IN ('OPEN', 'PENDING') GROUP BY v"
_KPIS = f"""p AS (SELECT unnest(['current', 'previous']) AS period, unnest([0, 30]) AS lo),
m AS (SELECT lo, count(*) AS created, count(first_response) AS responded, floor(avg(epoch_us(first_response) - epoch_us(created)) / 60e6 + 0.5)::BIGINT AS response_min
      FROM tickets JOIN p ON date_diff('day', created::DATE, DATE '{NOW[:10]}') BETWEEN lo AND lo + 29 GROUP BY lo),
r AS (SELECT lo, count(*) AS resolved, floor(avg((epoch_us(resolved) - epoch_us(created)) / 3600e6) * 10 + 0.5) / 10 AS resolution_h, round(avg(by_ai::INT), 6) AS ai_rate
      FROM tickets JOIN p ON date_diff('day', resolved::DATE, DATE '{NOW[:10]}') BETWEEN lo AND lo + 29 GROUP BY lo),
k AS (SELECT period, coalesce(created, 0)::BIGINT AS created, coalesce(responded, 0)::BIGINT AS responded, response_min,
      coalesce(resolved, 0)::BIGINT AS resolved, resolution_h, coalesce(ai_rate, 0)::DOUBLE AS ai_rate FROM p LEFT JOIN m USING (lo) LEFT JOIN r USING (lo))"""
_DUE = "CASE WHEN first_response IS NULL THEN response_due ELSE resolution_due END"
_SCAN = f"""k AS (SELECT *, ['JUNIOR', 'MID', 'SENIOR'][id // 4 % 3 + 1] AS level FROM tickets WHERE status <> 'RESOLVED' AND id % 9 <> 0),
l AS (SELECT *, {TS} > {_DUE} AS breached FROM k),
scan AS (SELECT *, CASE WHEN breached AND priority <> 'LOW' AND id % 7 > 0 THEN CASE level WHEN 'JUNIOR' THEN 'MID' WHEN 'MID' THEN 'SENIOR' END END AS up FROM l)"""

ORACLES = {
    "A8_open_by_priority": f"WITH {TICKETS_SQL} " + _COUNTS.format(c="priority", d=PRIORITIES),
    "A8_open_by_category": f"WITH {TICKETS_SQL} " + _COUNTS.format(c="category", d=CATEGORIES),
    "P1_ticket_queue": f"WITH {TICKETS_SQL} SELECT id, status, c_name AS title FROM tickets JOIN customer ON c_custkey = requester WHERE status <> 'RESOLVED' AND category = 'ACCESS' AND contains(lower(c_name), 'r#00000001')",
    "A9_top_requesters": "SELECT c_name AS name, count(*)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY n DESC, name LIMIT 5",
    "A5_window_kpis": f"WITH {TICKETS_SQL}, {_KPIS} SELECT * FROM k",
    "Fd7_kpi_delta": f"WITH {TICKETS_SQL}, {_KPIS}, s AS (SELECT max(created) FILTER (period = 'current') AS current, max(created) FILTER (period = 'previous') AS previous FROM k) SELECT current, previous, (CASE WHEN previous = 0 THEN current ELSE floor(100 * (current - previous) / previous + 0.5) END)::DOUBLE AS delta FROM s",
    "A7_daily_series": f"""WITH {TICKETS_SQL}, d AS (SELECT unnest(generate_series(DATE '{NOW[:10]}' - INTERVAL 29 DAY, DATE '{NOW[:10]}', INTERVAL 1 DAY))::DATE AS day)
      SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT count(*) FROM tickets WHERE created::DATE = day)::BIGINT AS created, (SELECT count(*) FROM tickets WHERE resolved::DATE = day AND by_ai)::BIGINT AS by_ai,
             (SELECT count(*) FROM tickets WHERE resolved::DATE = day AND NOT by_ai)::BIGINT AS by_people FROM d""",
    "A13_sla_states": f"""WITH {TICKETS_SQL}, s AS (SELECT *, {_DUE} AS due FROM tickets)
      SELECT priority, CASE WHEN status = 'RESOLVED' THEN CASE WHEN resolved IS NULL THEN 'none' WHEN resolved <= resolution_due THEN 'met' ELSE 'breached' END
        WHEN {TS} > due THEN 'breached' WHEN (epoch_us(due) - epoch_us({TS}))::DOUBLE / (epoch_us(due) - epoch_us(created)) <= 0.2 THEN 'at_risk' ELSE 'ok' END AS sla, count(*)::BIGINT AS n FROM s GROUP BY ALL""",
    "R7_breach_scan": f"WITH {TICKETS_SQL}, {_SCAN} SELECT id, level AS from_level, up AS to_level FROM scan WHERE up IS NOT NULL",
    "A29_scans": f"WITH {TICKETS_SQL}, {_SCAN} SELECT priority, count(*)::BIGINT AS scanned, count(*) FILTER (breached)::BIGINT AS breached, count(up)::BIGINT AS escalated FROM scan GROUP BY priority",
    "R7_scanned_again": f"WITH {TICKETS_SQL}, {_SCAN} SELECT priority, count(*)::BIGINT AS scanned, count(*) FILTER (breached)::BIGINT AS breached, 0::BIGINT AS escalated FROM scan WHERE up IS NULL GROUP BY priority",
    "P19_auto_delivery": f"""WITH {TICKETS_SQL}, c AS (SELECT l_orderkey AS id, bool_or(l_linestatus = 'F') AS cited, bool_or(l_tax > 0.07) AS bad, bool_or(l_returnflag = 'R' AND l_discount > 0.05) AS failed FROM lineitem GROUP BY 1),
      s AS (SELECT count(*) AS sent FROM orders WHERE o_orderkey % 41 = 0 AND o_orderdate <= {TS} AND o_orderdate::TIMESTAMP >= {TS} - INTERVAL 24 HOUR),
      g AS (SELECT id, row_number() OVER (ORDER BY id)::INT AS place FROM tickets JOIN c USING (id) WHERE id % 5 <> 0 AND category IN ('ACCESS', 'EMAIL') AND cited AND NOT bad AND NOT failed)
      SELECT id, place FROM g, s WHERE place + sent <= 60""",
    "A1_usage_rollup": f"SELECT event_type, user_id % 5 AS team, count(*)::BIGINT AS calls, round(sum(value), 2) AS tokens, floor(avg(value) + 0.5)::BIGINT AS latency FROM events WHERE ts <= TIMESTAMP '{UNTIL}' AND ts > TIMESTAMP '{UNTIL}' - INTERVAL 7 DAY GROUP BY ALL",
    "A6_status_pivot": f"WITH {TICKETS_SQL} SELECT priority, " + ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS \"{s}\"" for s in STATUSES) + " FROM tickets GROUP BY priority",
    "W2_step_gaps": "SELECT event_id, user_id, round(greatest(0.0, coalesce((epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-01 00:05:00'))) / 1e6, 0))::DOUBLE, 3) AS gap FROM events",
    "A28_tool_trail": "SELECT user_id, event_type, count(*)::BIGINT AS calls, min(event_id) AS first_at FROM events GROUP BY ALL",
    "R15_last_status": "SELECT user_id, arg_max(event_type, event_id) AS status, count(*)::BIGINT AS steps FROM events GROUP BY user_id",
    "W8_newest_per_user": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY place <= 3",
    "T6_page_with_flag": f"WITH {TICKETS_SQL} SELECT id, priority, (SELECT count(*) > 50 FROM tickets) AS truncated FROM tickets ORDER BY id LIMIT 50",
    "W6_assignees": """WITH l AS (SELECT l_suppkey, count(*) % 5 AS load FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), w AS (SELECT n_nationkey AS g, unnest([0, 1, 2]) AS r FROM nation),
      m AS (SELECT s_nationkey AS g, s_suppkey AS member, s_suppkey % 4 AS t, coalesce(load, 0)::BIGINT AS load FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey WHERE s_suppkey % 6 <> 0),
      b AS (SELECT w.g, r, member, load FROM w JOIN m ON m.g = w.g AND t >= r QUALIFY row_number() OVER (PARTITION BY w.g, r ORDER BY load, t, member) = 1)
      SELECT g AS "group", ['JUNIOR', 'MID', 'SENIOR'][r + 1] AS level, member, load FROM w LEFT JOIN b USING (g, r)""",
    "W6_least_loaded": "WITH l AS (SELECT l_suppkey, count(*)::BIGINT AS load FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT s_nationkey AS grp, s_suppkey AS member, coalesce(load, 0)::BIGINT AS load FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(load, 0), s_suppkey % 3, s_suppkey) = 1",
    "A12_coverage": f"SELECT round(count(DISTINCT c) / 7.0, 6)::DOUBLE AS coverage FROM (SELECT unnest(({CATEGORIES!r})[n_nationkey % 3 + 1 : n_nationkey % 3 + 2]) AS c FROM nation)",
    "T4_ticket_history": """WITH h AS (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS body, arg_max(text, turn) FILTER (role = 'assistant') AS outcome FROM conversations GROUP BY conv_id),
      p AS (SELECT *, left(body, 40) AS title FROM h WHERE contains(lower(body), 'the') OR contains(lower(body), 'ation') OR contains(lower(body), 'erea') ORDER BY id * 7 % 365 DESC, id DESC LIMIT 60),
      s AS (SELECT id, (SELECT sum(3 * coalesce(contains(lower(title), t), false)::INT + 2 * coalesce(contains(lower(outcome), t), false)::INT + coalesce(contains(lower(body), t), false)::INT) FROM (SELECT unnest(['the', 'ation', 'erea']) AS t))::INT AS score FROM p)
      SELECT id, score + CASE WHEN id % 3 > 0 THEN 2 ELSE 0 END AS score FROM s WHERE score > 0 ORDER BY score + CASE WHEN id % 3 > 0 THEN 2 ELSE 0 END DESC, CASE WHEN id % 3 > 0 THEN id * 11 % 500 ELSE id * 7 % 365 END DESC, id DESC LIMIT 20""",
}
