"""What becomes of incoming mail: a comment, a new ticket, a note of a failed delivery, or nothing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mail as M


def judged(mails: DataFrame) -> DataFrame:
    """``mails`` (sender, subject, body, headers) with what can be told from each alone: address, reason if
    automated, failed address, own words, ticket number."""
    address = M.sender(F.col("sender"))
    rows = mails.withColumn("address", address).withColumn("automated", M.automated(F.col("sender"), F.col("subject"), F.col("headers")))
    body = F.coalesce("body", F.lit(""))
    return rows.withColumns({"failed": F.when(F.col("automated").isNotNull(), M.failed_recipient(body)).otherwise(""), "words": M.own_words(body), "number": M.ticket_number(F.coalesce("subject", F.lit("")))})


def open_tickets(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number) of tickets that are not closed, and (failed, bounced), the newest of them of each requester's address."""
    live = tickets.where("status <> 'CLOSED'")
    latest = live.groupBy(F.col("requester_address").alias("failed")).agg(F.max_by("number", F.struct("updated", "number")).alias("bounced"))
    return live.select("number", F.lit(True).alias("live")), latest


def _met(rows: DataFrame, right: DataFrame, key: str, held: Column) -> DataFrame:
    """Left join by ``key`` of rows that hold one. Most mail holds none: it is spread by a hash of its other columns, not
    brought to the one task of the empty key, and meets nothing."""
    spread = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])
    away = F.col(key).isNull() | ~held
    left = rows.withColumn("_held", ~away).withColumn("_key", F.when(away, spread.cast("string")).otherwise(F.col(key).cast("string")))
    other = right.withColumn("_key", F.col(key).cast("string")).withColumn("_held", F.lit(True)).drop(key)
    return left.join(other, ["_key", "_held"], "left").drop("_key", "_held")


def placed(mails: DataFrame, tickets: DataFrame, own: Column | None = None) -> DataFrame:
    """``judged`` mails with action (comment, created, bounce, ignored), ticket and reason; works on a
    stream as well, where tickets are a table. tickets: number, status, requester_address, updated."""
    live, latest = open_tickets(tickets)
    rows = _met(_met(judged(mails), live, "number", F.col("number").isNotNull()), latest, "failed", F.col("failed") != "")
    loop = F.lit(False) if own is None else F.col("address") == own
    action = (
        F.when((F.col("address") == "") | loop, "ignored").when(F.col("automated").isNotNull(), F.when(F.col("bounced").isNotNull(), "bounce").otherwise("ignored"))
        .when(F.col("words") == "", "ignored").when(F.col("live"), "comment").otherwise("created")
    )
    reason = (
        F.when(F.col("address") == "", "Unparseable sender address.").when(loop, "Own notification address.")
        .when(F.col("automated").isNotNull(), F.when(F.col("bounced").isNull(), F.concat(F.lit("Automated mail — "), F.col("automated"), F.lit("."))))
        .when(F.col("words") == "", "Empty message body.")
    )
    ticket = F.when(action == "comment", F.col("number")).when(action == "bounce", F.col("bounced"))
    return rows.withColumns({"action": action, "ticket": ticket, "reason": reason, "name": M.sender_name(F.col("sender"), F.col("address")), "title": F.when(action == "created", M.title(F.coalesce("subject", F.lit(""))))})


def delivered_once(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """The first delivery of each message of a stream; repeats within the watermark's delay are dropped, and what is later than it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
