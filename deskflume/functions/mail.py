"""Incoming mail as columns: senders, threads, quoted text, automated mail, failed addresses."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SPACES

_ADDRESS = f"[^{SPACES}@]+@[^{SPACES}@]+\\.[^{SPACES}@]+"
#: Lines at which quoted text or a signature begins.
CUTS = (r"(?i)^\s*-{2,}\s*Original Message\s*-{2,}", r"(?i)^\s*On .+ wrote:\s*$", r"(?i)^\s*El .+ escribió:\s*$", r"^\s*_{5,}\s*$", r"(?i)^\s*From:\s.+", r"^\s*--\s*$")
#: What mail that no person sent is known by.
PRECEDENCES = ("bulk", "auto_reply", "junk", "list")
RESPONDERS = ("x-autoreply", "x-autorespond", "x-auto-response-suppress")
SENDERS = ("mailer-daemon", "postmaster", "no-reply", "noreply", "donotreply", "do-not-reply", "bounce", "bounces")
SUBJECTS = "delivery status notification|undeliverable|mail delivery (failed|subsystem)|returned mail|delivery has failed|out of office|automatic reply|auto[- ]?reply|autoresponse"
#: How reports of failed delivery name the address.
FAILED = (
    r"(?i)final-recipient:\s*rfc822;\s*([^\s<>]+@[^\s<>]+)", r"(?i)original-recipient:\s*rfc822;\s*([^\s<>]+@[^\s<>]+)",
    r"(?i)(?:wasn't|was not|couldn't be|could not be) delivered to\s*\**\s*([^\s<>*]+@[^\s<>*]+)", r"(?i)<([^\s<>]+@[^\s<>]+)>:?\s*(?:host|recipient|address)",
)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", "")


def _found(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def sender(source: Column) -> Column:
    """The bare address in lower case, from inside <> where there is one; empty if it is none."""
    raw = F.lower(_trimmed(F.coalesce(_found(F.regexp_extract(source, "<([^>]+)>", 1)), source)))
    return F.when(raw.rlike(f"^{_ADDRESS}$"), raw).otherwise("")


def sender_name(source: Column, address: Column) -> Column:
    """The name before <, or the parts of the address before @ with a capital each."""
    named = _found(_trimmed(F.regexp_extract(source, r"^\s*\"?([^\"<]+?)\"?\s*<", 1)))
    parts = F.filter(F.split(F.split_part(address, F.lit("@"), F.lit(1)), "[._-]+"), lambda p: p != "")
    return F.coalesce(named, F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1000))), " "))


def ticket_number(subject: Column) -> Column:
    """The number behind the first # with three digits or more; null without one."""
    return F.regexp_extract(subject, "#([0-9]{3,})", 1).try_cast("long")


def own_words(body: Column) -> Column:
    """The lines before the first cut that are no quotes; all of the text where nothing is left."""
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    cut = F.array_position(F.transform(lines, lambda x: reduce(Column.__or__, [x.rlike(p) for p in CUTS])), True).cast("int")
    kept = F.filter(F.when(cut > 0, F.slice(lines, F.lit(1), cut - 1)).otherwise(lines), lambda x: ~x.rlike(r"^\s*>"))
    return F.coalesce(_found(_trimmed(F.array_join(kept, "\n"))), _trimmed(body))


def automated(source: Column, subject: Column, headers: Column) -> Column:
    """Why no person sent a mail; null if one did. headers: a map with names in lower case, or null."""

    def header(name):
        return F.coalesce(F.lower(F.try_element_at(headers, F.lit(name))), F.lit(""))

    local = F.split_part(sender(source), F.lit("@"), F.lit(1))
    return (
        F.when(~header("auto-submitted").isin("", "no"), F.concat(F.lit("Auto-Submitted: "), header("auto-submitted")))
        .when(header("precedence").isin(*PRECEDENCES), F.concat(F.lit("Precedence: "), header("precedence")))
        .when(header("content-type").contains("report-type=delivery-status"), "Delivery status report")
        .when(F.regexp_replace(header("return-path"), r"\s", "") == "<>", "Empty return path (bounce)")
        .when(reduce(Column.__or__, [header(n) != "" for n in RESPONDERS]), "Auto-responder header")
        .when(local.isin(*SENDERS), F.concat(F.lit("Automated sender ("), local, F.lit(")")))
        .when(F.lower(F.coalesce(subject, F.lit(""))).rlike(SUBJECTS), "Automated subject line")
    )


def failed_recipient(body: Column) -> Column:
    """The address that a report says mail did not reach; empty if it names none."""
    first = F.coalesce(*[_found(F.regexp_extract(body, p, 1)) for p in FAILED], F.lit(""))
    return F.lower(F.regexp_replace(first, "[.,;]+$", ""))


def title(subject: Column) -> Column:
    plain = _trimmed(F.regexp_replace(_trimmed(subject), r"(?i)^\s*(re|fwd|rv)\s*:\s*", ""))
    return F.coalesce(_found(plain), F.lit("(no subject)"))
