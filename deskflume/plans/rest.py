"""Desk, library, run and catalogue queries made of few built-in functions each, and the same rows as SQL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import mail as M
from ..functions import values as V
from ..operators import mailbox as B
from ..operators import records as R
from ..tables import LIBRARY_SQL, NOW, TICKETS_SQL, library, now, table, tickets
from .desk import events
from .knowledge import rendered_parts

TS = f"TIMESTAMP '{NOW}'"
C = F.col


def customers(s, d):
    return table(s, d, "customer").select(C("c_custkey").alias("requester"), C("c_name").alias("name"), C("c_acctbal").alias("balance"), C("c_nationkey").alias("nation"))


def gate(s, d):
    """Drafts that may go out by themselves: category opted in, cited, checked, without a failed check, under the day's cap."""
    t = tickets(s, d).select("id", "category")
    failed = table(s, d, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("id"))
    cited = table(s, d, "lineitem").where("l_linestatus = 'F'").select(C("l_orderkey").alias("id"))
    opted = t.where(C("category").isin("ACCESS", "EMAIL"))
    return opted.join(cited, "id", "left_semi").join(failed, "id", "left_anti").select("id")


def profiles(s, d):
    k = C("s_suppkey")
    cats = F.array(*map(F.lit, ["HARDWARE", "SOFTWARE", "NETWORK", "ACCESS", "EMAIL", "SECURITY", "OTHER"]))
    return table(s, d, "supplier").where("s_acctbal > 0").select(k.alias("id"), F.slice(cats, (k % 5 + 1).cast("int"), 2).alias("categories"), (k * 7 % 101).alias("made"))


def chunk_scores(s, d):
    li = table(s, d, "lineitem")
    return li.select(C("l_partkey").alias("doc"), (C("l_discount") * 10).alias("rank"), (C("l_tax") * 10).alias("vec"), C("l_linenumber").alias("section"), (C("l_returnflag") == "R").alias("entity"))


def guesses(s, d):
    """Recognisers of name columns with confidences, over the values of part names."""
    p = table(s, d, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "w"))
    return p.select("p_partkey", C("w").alias("kind"), (F.length("w") / 10).alias("confidence"))


def recalls(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(_per_order()).alias("place"))
    return R.recall(li.where("l_linenumber = 1"))


def _per_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")


def millis():
    return F.when(C("event_id") % 2 == 0, C("event_id") * 7919 % 20_000_000).otherwise(C("event_id") * 37 % 90_000)


def complete():
    return now() - F.make_dt_interval(F.lit(0), F.lit(0), (C("id") % 4000).cast("int"))


def tier(k):
    """A member's tier, by arithmetic; one in five has a name that is none."""
    return F.get(F.array(*map(F.lit, ("JUNIOR", "MID", "SENIOR", "STANDALONE", "TRAINEE"))), (k % 5).cast("int"))


def replies(s, d):
    k = C("o_orderkey")
    title = F.concat(F.lit("  About\t"), F.repeat(F.lit("long  \n"), (k % 30).cast("int")), F.lit("end "))
    sent = F.when(k % 3 == 0, "Dear\r\nall").when(k % 3 == 1, "\u00a0Dear\nall \n").otherwise("Dear  all")
    return table(s, d, "orders").select(k.alias("id"), V.reply_subject(k, title).alias("subject"), V.edited(F.lit("Dear\nall"), sent).alias("edited"))


def principals(s, d):
    """How many documents each principal sees, own ones and those for all; suppliers whose key is a multiple of
    four stand for callers without a principal, who see nothing."""
    who = table(s, d, "supplier").select("s_suppkey", F.when(C("s_suppkey") % 4 > 0, C("s_suppkey") % 11).alias("owner"))
    lib = library(s, d)
    own = lib.where("visibility = 'PRIVATE'").groupBy("owner").agg(F.count("*").alias("own"))
    wide = lib.where("visibility <> 'PRIVATE'").agg(F.count("*").alias("wide"))
    return who.join(own, "owner", "left").join(F.broadcast(wide)).select("s_suppkey", F.when(C("owner").isNotNull(), F.coalesce("own", F.lit(0)) + C("wide")).otherwise(0).cast("long").alias("n"))


def idf(s, d):
    """Values of three columns of line items, by their share of the rows."""
    values = F.array(F.concat(F.lit("q"), C("l_quantity").cast("int")), F.concat(F.lit("f"), C("l_returnflag")), F.concat(F.lit("n"), C("l_linenumber")))
    items = table(s, d, "lineitem")
    counted = items.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(items.agg(F.count("*").alias("rows")))).select("value", V.idf_bucket(C("n") / C("rows")).alias("bucket"))


def mails(s, d):
    """Orders as mail of twelve kinds, by their key: (id, sender, subject, body, headers)."""
    k, kind = C("o_orderkey"), (C("o_orderkey") % 12).cast("int")

    def one_of(*values):
        return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), kind)

    about, none = F.format_string("RE: Fwd: About #%d again", k), F.lit(None).cast("string")
    sender = one_of("Ann Lee <Ann.Lee@Example.org>", "bob.j-smith@x.io", "no address", "Desk <desk@example.org>", "MAILER-DAEMON@mx.org", "news@x.org", "p@x.org", "relay@x.org", "q@x.org", "r_s@x.org", "t@x.org", ' "Eva M" <e@m.de>')
    subject = one_of(about, "fwd: Hello", about, about, "Failure", about, "Out of Office: gone", about, about, about, none, F.format_string(" rv : About #%d", k))
    failed = F.format_string("Sorry.\nFinal-Recipient: rfc822; Buyer%d@example.org.\nend", "o_custkey")
    body = one_of("Dear all\nit works\n> old", "Hi\n\nOn Monday X wrote:\nold", "x", "x", failed, none, "away", "It wasn't delivered to **nobody@example.org**", " \n ", "> only quotes", "Fine.\n-- \nT", "new\r\n----- Original Message -----\r\nold")
    header = one_of(none, none, none, none, none, "precedence", none, "return-path", none, none, "auto-submitted", none)
    value = one_of("", "", "", "", "", "Bulk", "", " < > ", "", "", "no", "")
    headers = F.when(header.isNotNull(), F.create_map(header, value))
    return table(s, d, "orders").select(k.alias("id"), sender.alias("sender"), subject.alias("subject"), body.alias("body"), headers.alias("headers"))


def mail_tickets(s, d):
    k = C("o_orderkey")
    return table(s, d, "orders").select(k.alias("number"), F.when(k % 4 == 0, "CLOSED").otherwise("OPEN").alias("status"), F.format_string("buyer%d@example.org", "o_custkey").alias("requester_address"), C("o_orderdate").alias("updated"))


def mail_ladder(s, d):
    rows = B.placed(mails(s, d), mail_tickets(s, d), F.lit("desk@example.org"))
    kept = C("action").isin("comment", "created")
    return rows.select("id", "action", "ticket", "reason", F.when(kept, C("name")).alias("name"), "title", F.when(kept, C("words")).alias("words"))


def model_json(s, d):
    """Answers around JSON, some of them broken."""
    k = C("p_partkey")
    text = F.format_string('Sure: {"summary": "part %d", "topics": ["A", "b", "a"]%s done', k, F.when(k % 5 == 0, "").otherwise("}"))
    got = V.loose_json(text, "summary string, topics array<string>")
    return table(s, d, "part").select("p_partkey", got["summary"].alias("summary"), F.array_join(V.distinct_topics(got["topics"]), ",").alias("topics"))


def sheets(s, d):
    rows = table(s, d, "nation").select(C("n_regionkey").alias("sheet"), C("n_nationkey").cast("long").alias("row"), C("n_name").alias("text"))
    return R.sheet_chunks(rows, "sheet", "row", "text", 19)


QUERIES = {
    "P4_either": lambda s, d: tickets(s, d).where((C("status") == "PENDING") | (C("resolved") >= F.lit("2000-01-01").cast("timestamp_ntz"))).select("id"),
    "P6_json_path": lambda s, d: events(s, d).where(F.get_json_object("props", "$.k") == "3").select("event_id"),
    "P7_distinct_from": lambda s, d: library(s, d).where(~C("source_id").eqNullSafe(C("collection"))).select("id"),
    "P8_library_filter": lambda s, d: library(s, d).where(C("visibility").isin("PUBLIC", "STAFF") & C("source_id").isNull() & F.contains(F.lower("text"), F.lit("thend"))).select("id"),
    "P10_intervals_meet": lambda s, d: tickets(s, d).where((C("created") < now()) & (F.coalesce("resolved", now()) > now() - F.expr("INTERVAL 3 DAYS"))).select("id"),
    "P11_numeric_facts": lambda s, d: K.facts(rendered_parts(s, d, "quantity")).where("kind = 'QUANTITY' AND unit = 'kg' AND num BETWEEN 10 AND 20").select("id"),
    "P15_redacted": lambda s, d: tickets(s, d).join(customers(s, d), "requester").select("id", F.when(C("requester") == 7, C("name")).otherwise("another requester (withheld)").alias("name")),
    "P17_row_floor": lambda s, d: library(s, d).where((C("owner") == 7) | C("visibility").isin("PUBLIC", "STAFF")).select("id"),
    "P17_no_principal": principals,
    "P19_delivery_gate": gate,
    "P20_discarded": lambda s, d: library(s, d).select("id").join(table(s, d, "labels").where("toxic = 1").select(C("doc_id").alias("id")), "id", "left_anti"),
    "P21_seniority": lambda s, d: tickets(s, d).select("id", V.least_level(C("priority")).alias("level"), V.next_level(V.least_level(C("priority"))).alias("next"), V.eligible(tier(C("id")), V.least_level(C("priority"))).alias("may_take")),
    "P22_subscribed": lambda s, d: profiles(s, d).where(F.array_contains("categories", "*") | F.array_contains("categories", "EMAIL")).select("id"),
    "P23_failed_steps": lambda s, d: events(s, d).where(C("event_type").startswith("error") | F.contains("props", F.lit('"error"'))).select("event_id"),
    "J2_compound_outer": lambda s, d: customers(s, d).join(tickets(s, d).where("status = 'PENDING'"), "requester", "left").groupBy("requester").agg(F.count("id").alias("pending")),
    "J9_siblings": lambda s, d: R.siblings(table(s, d, "supplier").where("s_suppkey IN (1, 5, 9)").select("s_suppkey"), table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey"),
    "J10_outranked": lambda s, d: R.outranked(table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey").select("p_partkey", "outranked"),
    "J12_one_user": lambda s, d: tickets(s, d).join(F.broadcast(customers(s, d).where("requester = 7").limit(1).select(C("requester").alias("u"), "nation"))).where("requester = u").select("id", "nation"),
    "J17_missing_policies": lambda s, d: R.missing(customers(s, d).select("requester"), tickets(s, d).where("priority = 'URGENT' AND by_ai"), "requester"),
    "J18_newest_open": lambda s, d: R.latest(tickets(s, d).where("status <> 'RESOLVED'"), "requester", F.struct("created", "id"), "id"),
    "J19_note_of_record": lambda s, d: R.of_record(table(s, d, "conversations"), "conv_id", "(?i)resolv|solution|tion").select("conv_id", F.sha2("note", 256).alias("note")),
    "J21_update_from": lambda s, d: R.with_defaults(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "supplier").where("s_nationkey < 5").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey", "s_acctbal"),
    "J22_has_key": lambda s, d: R.flagged(customers(s, d).select("requester"), tickets(s, d).where("priority = 'URGENT'").select("requester"), "requester", "urgent"),
    "A10_informed_share": lambda s, d: R.share_of(events(s, d), "user_id", C("event_type") == "purchase"),
    "A11_this_month": lambda s, d: tickets(s, d).where((C("created") >= F.date_trunc("month", now()).cast("timestamp_ntz")) & (C("created") < now())).agg(F.count("*").alias("n")),
    "A14_child_counts": lambda s, d: tickets(s, d).groupBy("requester").agg(F.count("*").alias("tickets"), F.count_if(C("status") != "RESOLVED").alias("open")),
    "A15_per_kind": lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("n")),
    "A17_matching": lambda s, d: library(s, d).where((C("visibility") != "PRIVATE") & ~C("gone") & F.contains("text", F.lit("tion"))).agg(F.count("*").alias("n")),
    "A18_route_scores": lambda s, d: R.route_scores(chunk_scores(s, d)).withColumns({"best_rank": F.round("best_rank", 6), "best_vec": F.round("best_vec", 6)}),
    "A22_objects_below": lambda s, d: R.objects_below(table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("key"), F.length("html").cast("long").alias("size"))),
    "A26_types": lambda s, d: R.best_guess(guesses(s, d), "p_partkey").groupBy("kind").agg(F.count("*").alias("n")),
    "A27_run_totals": lambda s, d: events(s, d).groupBy("user_id").agg(F.count_if(C("event_type") == "click").alias("calls"), F.count_if(C("event_type") == "error").alias("errors"), F.count_if((C("event_type") == "signup") & (C("value") > 50)).alias("approved")),
    "A30_sent_today": lambda s, d: tickets(s, d).where(C("by_ai") & (C("first_response") > now() - F.expr("INTERVAL 24 HOURS")) & (C("first_response") <= now())).agg(F.count("*").alias("n")),
    "A31_node_sizes": lambda s, d: library(s, d).where("NOT gone").groupBy("collection").agg(F.count("*").alias("documents"), F.count("source_id").alias("from_sources")),
    "A32_recall": recalls,
    "W5_best_guess": lambda s, d: R.best_guess(guesses(s, d), "p_partkey"),
    "W7_first_group": lambda s, d: R.first_covering(profiles(s, d), "categories", F.struct("made", "id"), "id"),
    "W12_rolling_log": lambda s, d: R.newest_kept(events(s, d), "event_type", [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "place"),
    "T2_routed": lambda s, d: R.routed(R.route_scores(chunk_scores(s, d)), 25),
    "T5_listed": lambda s, d: tickets(s, d).select("id", "status").orderBy(F.desc("id")).limit(min(500, 200)),
    "T7_next_page": lambda s, d: table(s, d, "lineitem").where("l_orderkey > 40 OR (l_orderkey = 40 AND l_linenumber > 1)").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").limit(3),
    "T8_admitted": lambda s, d: table(s, d, "part").select("p_partkey", (C("p_size") % 2 == 0).alias("sampled")).orderBy("sampled", "p_partkey").limit(40),
    "T10_skills": lambda s, d: table(s, d, "part").select("p_partkey", C("p_type").startswith("ECONOMY").alias("applies")).orderBy(F.desc("applies"), "p_partkey").limit(40),
    "Fs7_identifiers": lambda s, d: table(s, d, "part").select("p_partkey", K.normal_identifier(F.concat("p_brand", F.lit("_/"), "p_type", F.lit(" é"))).alias("name")),
    "Fs8_shapes": lambda s, d: table(s, d, "customer").select("c_custkey", V.shape(F.concat("c_name", F.lit(" "), F.lower("c_mktsegment"), F.lit("@x.Ü"))).alias("shape")),
    "Fs11_mail": lambda s, d: mails(s, d).select("id", M.sender(C("sender")).alias("address"), M.ticket_number(C("subject")).alias("number"), M.own_words(F.coalesce("body", F.lit(""))).alias("words")),
    "Fs12_reply_subject": lambda s, d: replies(s, d),
    "Fs13_retreat": lambda s, d: library(s, d).select("id", V.retreat(C("text"), 200).alias("head")),
    "Fs17_sample": lambda s, d: library(s, d).select("id", F.sha2(V.sample_text(C("text"), 502), 256).alias("sample")),
    "Fs18_model_json": model_json,
    "R8_mail_threads": mail_ladder,
    "Fd1_epoch_millis": lambda s, d: table(s, d, "orders").select("o_orderkey", V.epoch_millis(F.to_date("o_orderdate")).alias("millis")),
    "Fd2_quarters": lambda s, d: table(s, d, "orders").select("o_orderkey", V.quarter_label(C("o_orderdate"), -1).alias("label")),
    "Fd5_sla_labels": lambda s, d: tickets(s, d).select("id", V.sla_label(F.when(C("id") % 11 == 0, "none").when(C("resolved").isNotNull(), "met").otherwise("ok"), F.timestamp_diff("SECOND", now(), C("resolution_due"))).alias("label")),
    "Fd8_durations": lambda s, d: table(s, d, "events").select("event_id", V.duration_label(millis()).alias("label"), V.gap_label(millis() - 500).alias("gap")),
    "Fd9_staleness": lambda s, d: tickets(s, d).where(C("created") <= now()).select("id", V.staleness(F.when(C("id") % 7 == 0, "UNREACHABLE").otherwise("READY"), complete(), complete() + F.make_dt_interval(F.lit(0), (C("id") % 3 - 1).cast("int")), now()).alias("age")),
    "Fd10_freshness": lambda s, d: tickets(s, d).where(C("created") <= now()).select("id", V.freshness(F.timestamp_diff("HOUR", C("created"), now())).alias("f")).select("id", "f.*"),
    "Fm2_hashed_vectors": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.transform(V.hashed_vector(C("p_name"), 8, 12), lambda x: F.round(x, 4).cast("decimal(10,4)")), ",").alias("v")),
    "Fm7_idf": idf,
    "Fm9_thirds": lambda s, d: table(s, d, "part").select("p_partkey", V.third(C("p_size").cast("double"), 15.0, 35.0).alias("third")),
    "E8_summaries": lambda s, d: library(s, d).select("id", F.substring("text", 1, 300).alias("summary")),
    "E3_sheet_chunks": sheets,
    "F10_rolled_up": lambda s, d: R.rolled_up(table(s, d, "lineitem").select(C("l_partkey").alias("a"), C("l_suppkey").alias("b"), F.when(C("l_returnflag") == "N", "TEMPORAL").otherwise("KEYS").alias("kind"), C("l_discount").alias("weight"))),
    "F13_retention": lambda s, d: R.missing(library(s, d).select("id"), library(s, d).where("gone").select("id"), "id"),
    "R5_purge": lambda s, d: R.purged(library(s, d), "id", C("gone"), table(s, d, "labels").select(C("doc_id").alias("id"))),
    "R11_circuits": lambda s, d: R.open_circuits(table(s, d, "events"), "user_id", C("value") > 30, "ts", ["ts", "event_id"], 3, 60 * 24),
    "R14_may_run": lambda s, d: events(s, d).groupBy("user_id").agg((F.max(F.when(C("event_type") == "click", C("ts"))) <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 15 MINUTES")).alias("may")),
    "S21_fact_upsert": lambda s, d: R.replaced(table(s, d, "orders").select("o_orderkey", "o_totalprice"), table(s, d, "orders").where("o_orderkey % 9 = 0").select("o_orderkey", (C("o_totalprice") + 1).alias("o_totalprice")), "o_orderkey"),
    "S27_backfill": lambda s, d: R.missing(library(s, d).select("id"), table(s, d, "labels").select(C("doc_id").alias("id")), "id"),
}

_SCORES = "s AS (SELECT l_partkey AS doc, max(l_discount * 10) AS best_rank, max(l_tax * 10) AS best_vec, count(DISTINCT CASE WHEN l_discount * 10 >= 0.15::DOUBLE THEN l_linenumber END)::BIGINT AS sections, bool_or(l_returnflag = 'R') AS entity_hit FROM lineitem GROUP BY 1)"
_PROFILES = "p AS (SELECT s_suppkey AS id, (['HARDWARE', 'SOFTWARE', 'NETWORK', 'ACCESS', 'EMAIL', 'SECURITY', 'OTHER'])[s_suppkey % 5 + 1 : s_suppkey % 5 + 2] AS categories, s_suppkey * 7 % 101 AS made FROM supplier WHERE s_acctbal > 0)"
_GUESS = "g AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS kind FROM part), b AS (SELECT p_partkey, kind, length(kind) / 10.0::DOUBLE AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(kind) DESC, kind) = 1)"
_LEVEL = "CASE priority WHEN 'URGENT' THEN 'SENIOR' WHEN 'HIGH' THEN 'MID' ELSE 'JUNIOR' END"
_MAIL = "m AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS made, o_orderkey % 12 AS s FROM orders)"
_MIN = f"date_diff('second', {TS}, resolution_due)"
_LEFT = f"(CASE WHEN {_MIN} >= 0 THEN floor({_MIN} / 60.0) ELSE ceil({_MIN} / 60.0) END)::BIGINT"
_DAYS = f"date_diff('day', created::DATE, {TS}::DATE)"
_HOURS = f"floor((epoch({TS}) - epoch(created)) / 3600)"
_LABEL = """CASE WHEN {m} < 1000 THEN '<1s' WHEN ({m} + 500) // 1000 < 60 THEN ({m} + 500) // 1000 || 's' WHEN ({m} + 500) // 60000 < 60 THEN ({m} + 500) // 60000 || 'm ' || lpad((({m} + 500) // 1000 % 60)::VARCHAR, 2, '0') || 's'
  ELSE ({m} + 500) // 3600000 || 'h ' || lpad((({m} + 500) // 60000 % 60)::VARCHAR, 2, '0') || 'm' END"""
_KEYS = "SELECT p_partkey, p_type FROM part"

ORACLES = {
    "P4_either": f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE status = 'PENDING' OR resolved >= TIMESTAMP '2000-01-01'",
    "P6_json_path": "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'",
    "P7_distinct_from": f"WITH {LIBRARY_SQL} SELECT id FROM library WHERE source_id IS DISTINCT FROM collection",
    "P8_library_filter": f"WITH {LIBRARY_SQL} SELECT id FROM library WHERE visibility IN ('PUBLIC', 'STAFF') AND source_id IS NULL AND contains(lower(text), 'thend')",
    "P10_intervals_meet": f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE created < {TS} AND coalesce(resolved, {TS}) > {TS} - INTERVAL 3 DAY",
    "P11_numeric_facts": "SELECT p_partkey AS id FROM part WHERE p_partkey % 50 BETWEEN 10 AND 20",
    "P15_redacted": "SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 THEN c_name ELSE 'another requester (withheld)' END AS name FROM orders JOIN customer ON c_custkey = o_custkey",
    "P17_row_floor": f"WITH {LIBRARY_SQL} SELECT id FROM library WHERE owner = 7 OR visibility IN ('PUBLIC', 'STAFF')",
    "P17_no_principal": f"WITH {LIBRARY_SQL}, u AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 11 END AS u FROM supplier), o AS (SELECT owner, count(*) AS own FROM library WHERE visibility = 'PRIVATE' GROUP BY owner), w AS (SELECT count(*) AS wide FROM library WHERE visibility <> 'PRIVATE') SELECT s_suppkey, CASE WHEN u IS NULL THEN 0 ELSE coalesce(own, 0) + wide END::BIGINT AS n FROM u LEFT JOIN o ON o.owner = u.u CROSS JOIN w",
    "P19_delivery_gate": f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE category IN ('ACCESS', 'EMAIL') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')",
    "P20_discarded": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "P21_seniority": f"""WITH {TICKETS_SQL}, l AS (SELECT id, {_LEVEL} AS level, id % 5 AS t FROM tickets)
      SELECT id, level, CASE level WHEN 'JUNIOR' THEN 'MID' WHEN 'MID' THEN 'SENIOR' END AS next, CASE t WHEN 3 THEN true WHEN 2 THEN true WHEN 1 THEN level <> 'SENIOR' ELSE level = 'JUNIOR' END AS may_take FROM l""",
    "P22_subscribed": f"WITH {_PROFILES} SELECT id FROM p WHERE list_contains(categories, 'EMAIL')",
    "P23_failed_steps": "SELECT event_id FROM events WHERE starts_with(event_type, 'error') OR contains(props, '\"error\"')",
    "J2_compound_outer": f"WITH {TICKETS_SQL} SELECT c_custkey AS requester, count(id)::BIGINT AS pending FROM customer LEFT JOIN tickets ON requester = c_custkey AND status = 'PENDING' GROUP BY 1",
    "J9_siblings": "SELECT a.s_suppkey AS seed, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey IN (1, 5, 9)",
    "J10_outranked": "SELECT p_partkey, EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND (q.p_retailprice > p.p_retailprice OR q.p_retailprice = p.p_retailprice AND q.p_partkey < p.p_partkey)) AS outranked FROM part p",
    "J12_one_user": "SELECT o_orderkey AS id, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = 7 AND o_custkey = c_custkey",
    "J17_missing_policies": "SELECT c_custkey AS requester FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE left(o_orderpriority, 1) = '1' AND o_orderkey % 3 = 0)",
    "J18_newest_open": f"WITH {TICKETS_SQL} SELECT requester, id FROM tickets WHERE status <> 'RESOLVED' QUALIFY row_number() OVER (PARTITION BY requester ORDER BY created DESC, id DESC) = 1",
    "J19_note_of_record": "SELECT conv_id, sha256(coalesce(arg_max(text, turn) FILTER (regexp_matches(text, '(?i)resolv|solution|tion')), arg_max(text, turn))) AS note FROM conversations GROUP BY conv_id",
    "J21_update_from": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier",
    "J22_has_key": f"WITH {TICKETS_SQL} SELECT c_custkey AS requester, c_custkey IN (SELECT requester FROM tickets WHERE priority = 'URGENT') AS urgent FROM customer",
    "A10_informed_share": "SELECT round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END)::DOUBLE / nullif(count(DISTINCT user_id), 0), 6) AS share FROM events",
    "A11_this_month": f"WITH {TICKETS_SQL} SELECT count(*)::BIGINT AS n FROM tickets WHERE created >= date_trunc('month', {TS}) AND created < {TS}",
    "A14_child_counts": f"WITH {TICKETS_SQL} SELECT requester, count(*)::BIGINT AS tickets, count(*) FILTER (status <> 'RESOLVED')::BIGINT AS open FROM tickets GROUP BY requester",
    "A15_per_kind": "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type",
    "A17_matching": f"WITH {LIBRARY_SQL} SELECT count(*)::BIGINT AS n FROM library WHERE visibility <> 'PRIVATE' AND NOT gone AND contains(text, 'tion')",
    "A18_route_scores": f"WITH {_SCORES} SELECT doc, round(best_rank, 6) AS best_rank, round(best_vec, 6) AS best_vec, sections, entity_hit FROM s",
    "A22_objects_below": """WITH k AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p, length(html)::BIGINT AS size FROM pages),
      x AS (SELECT unnest(list_distinct([array_to_string(p[1:i], '/') for i in range(1, greatest(len(p) - 1, 1) + 1)])) AS prefix, lower(regexp_extract(p[-1], '.\\.([A-Za-z0-9]+)$', 1)) AS ext, size FROM k),
      g AS (SELECT prefix, ext, count(*) AS n, sum(size) AS bytes FROM x GROUP BY ALL)
      SELECT prefix, sum(n)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes, string_agg(ext || '=' || n, ',' ORDER BY ext) AS extensions FROM g GROUP BY prefix""",
    "A26_types": f"WITH {_GUESS} SELECT kind, count(*)::BIGINT AS n FROM b GROUP BY kind",
    "A27_run_totals": "SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS calls, count(*) FILTER (event_type = 'error')::BIGINT AS errors, count(*) FILTER (event_type = 'signup' AND value > 50)::BIGINT AS approved FROM events GROUP BY user_id",
    "A30_sent_today": f"WITH {TICKETS_SQL} SELECT count(*)::BIGINT AS n FROM tickets WHERE by_ai AND first_response > {TS} - INTERVAL 24 HOUR AND first_response <= {TS}",
    "A31_node_sizes": f"WITH {LIBRARY_SQL} SELECT collection, count(*)::BIGINT AS documents, count(source_id)::BIGINT AS from_sources FROM library WHERE NOT gone GROUP BY collection",
    "A32_recall": "WITH r AS (SELECT l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS place FROM lineitem) SELECT round(avg((place <= 1)::INT), 6)::DOUBLE AS recall_1, round(avg((place <= 3)::INT), 6)::DOUBLE AS recall_3 FROM r WHERE l_linenumber = 1",
    "W5_best_guess": f"WITH {_GUESS} SELECT * FROM b",
    "W7_first_group": f"WITH {_PROFILES}, c AS (SELECT id, made, unnest(categories) AS category FROM p) SELECT category, id FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY made, id) = 1",
    "W12_rolling_log": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY place <= 20",
    "T2_routed": f"WITH {_SCORES} SELECT doc, entity_hit, round(0.5::DOUBLE * best_rank + 0.5::DOUBLE * best_vec + least(sections, 3) * 0.05::DOUBLE, 6) AS score, (SELECT count(*) FROM s)::BIGINT AS total FROM s ORDER BY entity_hit DESC NULLS LAST, score DESC, doc LIMIT 25",
    "T5_listed": f"WITH {TICKETS_SQL} SELECT id, status FROM tickets ORDER BY id DESC LIMIT 200",
    "T7_next_page": "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (40, 1) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 3",
    "T8_admitted": "SELECT p_partkey, p_size % 2 = 0 AS sampled FROM part ORDER BY sampled, p_partkey LIMIT 40",
    "T10_skills": "SELECT p_partkey, starts_with(p_type, 'ECONOMY') AS applies FROM part ORDER BY applies DESC, p_partkey LIMIT 40",
    "Fs7_identifiers": "SELECT p_partkey, lower(replace(replace(p_brand, '#', ''), ' ', '') || replace(p_type, ' ', '')) AS name FROM part",
    "Fs8_shapes": "SELECT c_custkey, 'Aa{7}#' || repeat('N', length(c_name) - 9) || ' a{' || length(c_mktsegment) || '}@a.Ü' AS shape FROM customer",
    "Fs11_mail": f"""WITH {_MAIL} SELECT k AS id, ['ann.lee@example.org', 'bob.j-smith@x.io', '', 'desk@example.org', 'mailer-daemon@mx.org', 'news@x.org', 'p@x.org', 'relay@x.org', 'q@x.org', 'r_s@x.org', 't@x.org', 'e@m.de'][s + 1] AS address,
      CASE WHEN k >= 100 AND s NOT IN (1, 4, 6, 10) THEN k END AS number,
      ['Dear all' || chr(10) || 'it works', 'Hi', 'x', 'x', 'Sorry.' || chr(10) || 'Final-Recipient: rfc822; Buyer' || c || '@example.org.' || chr(10) || 'end', '', 'away', 'It wasn''t delivered to **nobody@example.org**', '', '> only quotes', 'Fine.', 'new'][s + 1] AS words FROM m""",
    "Fs12_reply_subject": """WITH t AS (SELECT o_orderkey AS id, 'About ' || repeat('long ', (o_orderkey % 30)::INT) || 'end' AS t FROM orders)
      SELECT id, 'Re: [Desk] #' || id || ' ' || CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS subject, id % 3 = 2 AS edited FROM t""",
    "Fs13_retreat": f"WITH {LIBRARY_SQL}, h AS (SELECT id, text, left(text, 200) AS head FROM library), b AS (SELECT *, regexp_extract(head, '(?s)^(.*[.\\n])', 1) AS back FROM h) SELECT id, CASE WHEN length(text) <= 200 THEN text WHEN back <> '' THEN back ELSE head END AS head FROM b",
    "Fs17_sample": rf"""WITH t AS (SELECT doc_id AS id, regexp_replace(text, '[\t-\r \x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+\n', chr(10), 'g') AS t FROM documents), g AS (SELECT chr(10) || chr(10) || '[…]' || chr(10) || chr(10) AS gap)
      SELECT id, sha256(CASE WHEN length(t) <= 502 THEN t ELSE left(t, 301) || gap || substr(t, (length(t) - 100) // 2 + 1, 100) || gap || right(t, 101) END) AS sample FROM t CROSS JOIN g""",
    "Fs18_model_json": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'part ' || p_partkey END AS summary, CASE WHEN p_partkey % 5 <> 0 THEN 'A,b' END AS topics FROM part",
    "R8_mail_threads": f"""WITH {_MAIL}, t AS (SELECT c, k AS number FROM m WHERE k % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY made DESC, k DESC) = 1),
      a AS (SELECT m.*, t.number AS bounced, CASE WHEN s IN (0, 1, 10) THEN 'created' WHEN s IN (9, 11) THEN CASE WHEN k >= 100 THEN 'comment' ELSE 'created' END WHEN s = 4 AND t.number IS NOT NULL THEN 'bounce' ELSE 'ignored' END AS action FROM m LEFT JOIN t USING (c))
      SELECT k AS id, action, CASE action WHEN 'comment' THEN k WHEN 'bounce' THEN bounced END AS ticket,
        CASE WHEN action = 'ignored' THEN CASE s WHEN 2 THEN 'Unparseable sender address.' WHEN 3 THEN 'Own notification address.' WHEN 4 THEN 'Automated mail — Automated sender (mailer-daemon).' WHEN 5 THEN 'Automated mail — Precedence: bulk.'
          WHEN 6 THEN 'Automated mail — Automated subject line.' WHEN 7 THEN 'Automated mail — Empty return path (bounce).' ELSE 'Empty message body.' END END AS reason,
        CASE WHEN action IN ('comment', 'created') THEN CASE s WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob J Smith' WHEN 9 THEN 'R S' WHEN 10 THEN 'T' ELSE 'Eva M' END END AS name,
        CASE WHEN action = 'created' THEN CASE s WHEN 0 THEN 'Fwd: About #' || k || ' again' WHEN 1 THEN 'Hello' WHEN 9 THEN 'Fwd: About #' || k || ' again' WHEN 10 THEN '(no subject)' ELSE 'About #' || k END END AS title,
        CASE WHEN action IN ('comment', 'created') THEN CASE s WHEN 0 THEN 'Dear all' || chr(10) || 'it works' WHEN 1 THEN 'Hi' WHEN 9 THEN '> only quotes' WHEN 10 THEN 'Fine.' ELSE 'new' END END AS words FROM a""",
    "Fd1_epoch_millis": "SELECT o_orderkey, (epoch(o_orderdate::DATE) * 1000)::BIGINT AS millis FROM orders",
    "Fd2_quarters": "WITH q AS (SELECT o_orderkey, date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH AS m FROM orders) SELECT o_orderkey, 'Q' || quarter(m) || ' ' || year(m) AS label FROM q",
    "Fd5_sla_labels": f"""WITH {TICKETS_SQL}, m AS (SELECT id, resolved, floor((epoch(resolution_due) - epoch({TS})) / 60.0 + 0.5)::BIGINT AS m FROM tickets), a AS (SELECT *, abs(m) AS a FROM m)
      SELECT id, CASE WHEN id % 11 = 0 THEN '—' WHEN resolved IS NOT NULL THEN 'Met' ELSE CASE WHEN a >= 1440 THEN (a + 720) // 1440 || 'd' WHEN a >= 60 THEN (a + 30) // 60 || 'h' ELSE a || 'm' END || CASE WHEN m >= 0 THEN ' left' ELSE ' over' END END AS label FROM a""",
    "Fd8_durations": f"""WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 7919 % 20000000 ELSE event_id * 37 % 90000 END AS m FROM events),
      g AS (SELECT event_id, m, greatest(m - 500, 0) AS g FROM m)
      SELECT event_id, {_LABEL.format(m="m")} AS label, '+' || CASE WHEN g < 10000 THEN (g + 50) // 1000 || '.' || (g + 50) // 100 % 10 || 's' ELSE {_LABEL.format(m="g")} END AS gap FROM g""",
    "Fd9_staleness": f"""WITH {TICKETS_SQL}, a AS (SELECT id, floor((epoch({TS}) - epoch({TS} - to_minutes((id % 4000)::INT))) / 3600)::BIGINT AS h FROM tickets WHERE created <= {TS})
      SELECT id, CASE WHEN id % 7 = 0 THEN 'unavailable now' WHEN id % 3 < 2 THEN NULL WHEN h < 1 THEN 'less than an hour ago' WHEN h < 24 THEN h || 'h ago' ELSE h // 24 || 'd ago' END AS age FROM a""",
    "Fd10_freshness": f"WITH {TICKETS_SQL}, h AS (SELECT id, {_HOURS} AS h FROM tickets WHERE created <= {TS}) SELECT id, h >= 24 AS tier1_due, h >= 720 AS resample_due, h > 2160 AS expired FROM h",
    "Fm2_hashed_vectors": """WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9-]+') AS w FROM part), i AS (SELECT p_partkey, list_transform(w, lambda x: ('0x' || left(sha256(x), 4))::INT % 8) AS i FROM w),
      c AS (SELECT p_partkey, [len(list_filter(i, lambda x: x = k)) for k in range(8)] AS c FROM i), n AS (SELECT p_partkey, c, sqrt(list_sum([x * x for x in c])) AS n FROM c)
      SELECT p_partkey, array_to_string(list_concat([CASE WHEN n > 0 THEN format('{:.4f}', x / n) ELSE '0.0000' END for x in c], ['0.0000', '0.0000', '0.0000', '0.0000']), ',') AS v FROM n""",
    "Fm7_idf": """WITH v AS (SELECT unnest(['q' || l_quantity::INT, 'f' || l_returnflag, 'n' || l_linenumber]) AS value FROM lineitem), n AS (SELECT value, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS s FROM v GROUP BY value)
      SELECT value, CASE WHEN s <= 0.05 THEN 'rare' WHEN s <= 0.25 THEN 'uncommon' ELSE 'common' END AS bucket FROM n""",
    "Fm9_thirds": "SELECT p_partkey, CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 35 THEN 'medium' ELSE 'high' END AS third FROM part",
    "E8_summaries": "SELECT doc_id AS id, left(text, 300) AS summary FROM documents",
    "E3_sheet_chunks": "SELECT n_regionkey AS sheet, n_nationkey // 10 AS window, min(n_nationkey)::BIGINT AS first_row, max(n_nationkey)::BIGINT AS last_row, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS lines FROM nation GROUP BY 1, 2",
    "F10_rolled_up": "SELECT l_partkey AS a, l_suppkey AS b, coalesce(max(CASE WHEN l_returnflag <> 'N' THEN l_discount END), 0.0) AS weight FROM lineitem GROUP BY 1, 2",
    "F13_retention": "SELECT doc_id AS id FROM documents WHERE doc_id % 17 <> 0",
    "R5_purge": "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'tombstone' ELSE 'purge' END AS action FROM documents WHERE doc_id % 17 = 0",
    "R11_circuits": """WITH f AS (SELECT user_id, ts, event_id, value > 30 AS failed FROM events),
      w AS (SELECT *, lag(failed, 1, false) OVER u AS f1, lag(failed, 2, false) OVER u AS f2, lag(failed, 3, false) OVER u AS f3 FROM f WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM w),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) AS nth FROM r) WHERE failed AND f1 AND f2 AND nth = 3)
      SELECT o.user_id, o.ts AS opened_at, least(o.ts + INTERVAL 24 HOUR, (SELECT min(g.ts) FROM f g WHERE g.user_id = o.user_id AND NOT g.failed AND (g.ts, g.event_id) > (o.ts, o.event_id))) AS until FROM o""",
    "R14_may_run": "SELECT user_id, max(ts) FILTER (event_type = 'click') <= TIMESTAMP '2024-01-29 23:45:00' AS may FROM events GROUP BY user_id",
    "S21_fact_upsert": "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders",
    "S27_backfill": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
